"""What several tables of a scan need is worked out once."""

import threading

from archgraph.functions import net
from archgraph.operators import merge, scan
from archgraph.session import together
from archgraph.sources import builtin, dockerfile, dotenv

FILE = "repo string, path string, size bigint, mtime bigint, content string"


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(a) or real(*a, **k))
    return calls


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_value_is_parsed_once_and_not_by_a_filter_too(spark):
    df = spark.createDataFrame([("DB_HOST", "db:5432"), ("MODE", "dev")], "key string, value string")
    refs = net.parse_references(df, "key", "value")
    assert "Filter" not in plan(refs)
    assert [(r["key"], r["ref"]["port"]) for r in refs.collect()] == [("DB_HOST", 5432)]


def test_settings_and_build_files_are_read_once(spark, monkeypatch):
    entries, lines = counted(monkeypatch, dotenv, "entries"), counted(monkeypatch, dockerfile, "logical_lines")
    rows = [("r", "a/.env", 9, 0, "DB_HOST=db:5432\nWEB_URL=https://your-tenant.io/<x>"), ("r", "a/Dockerfile", 9, 0, "FROM redis:7\nENV UP_HOST=x:1"),
            ("r", "b/Dockerfile", 9, 0, "RUN x")]
    found = scan.extract(spark.createDataFrame(rows, FILE))
    assert [(r["path"], r["raw"]) for r in found["hints"].orderBy("path").collect()] == [("a/.env", "db:5432"), ("a/Dockerfile", "x:1")]
    assert sorted(r["code"] for r in found["diagnostics"].collect()) == ["dockerfile_no_base_image", "env_placeholder_reference"]
    assert (len(entries), len(lines)) == (1, 1)


def test_a_stored_setting_is_masked(spark):
    files = spark.createDataFrame([("r", "", ".env", "API_TOKEN=https://tok.example.com/x\nDB_URL=postgres://u:secret@db/x")],
                                  "repo string, dir string, file_name string, content string")
    refs = dotenv.references(files)
    assert not any("secret" in str(r) or "tok.example.com/x" in str(r["masked"]) for r in refs.collect())


def test_libraries_read_written_hints(spark, monkeypatch):
    asked, crossed = counted(monkeypatch, scan, "corroborate"), counted(monkeypatch, scan.joins, "cross_project_report")
    rows = [("r", "a/package.json", 9, 0, '{"name":"a","dependencies":{"pg":"8","stripe":"1"}}')]
    made = scan.scan(spark.createDataFrame(rows, FILE))
    assert {r["dst"] for r in made["edges"].collect()} == {"context:stripe"}
    assert "sha2" not in plan(asked[0][0])
    assert not crossed  # only diagnostics ask for it


def test_independent_steps_run_at_the_same_time(spark):
    met = threading.Barrier(2, timeout=60)
    assert together(spark, lambda: met.wait() >= 0 and spark.range(3).count(), lambda: met.wait() >= 0 and spark.range(5).count()) == [3, 5]


def test_kind_name_and_place_come_from_one_pass(spark):
    rows = [("r", "x", 2, 80, "queue", "", "X", "directory", "", "b", 1, "."), ("r", "x", 1, 100, "service", "i", "Y", None, "n", "a", 2, "."),
            ("r", "y", 1, 40, "service", "", "Z", "directory", "", "c", 3, ".")]
    r = spark.createDataFrame(rows, "repo string, id string, seq int, conf_pct int, kind string, image string, name string, name_from string, "
                                    "namespace string, path string, line int, project string")
    got = merge.merge_place(r).orderBy("id").collect()
    apart = merge.merge_kind(r).join(merge.merge_name(r), ["repo", "id"]).orderBy("id").collect()
    assert [(g["kind"], g["name"], g["namespace"]) for g in got] == [(a["kind"], a["name"], a["namespace"]) for a in apart]
    assert [(g["path"], g["line"]) for g in got] == [("a", 2), ("c", 3)]
    assert plan(merge.merge_place(r)).count("Aggregate") == 1


def test_dependency_lists_are_dealt_before_they_are_read(spark, monkeypatch):
    written = counted(monkeypatch, builtin, "durable")
    rows = [("r", f"a{i}/requirements.txt", 9, 0, "redis==1") for i in range(40)]
    scan.extract(spark.createDataFrame(rows, FILE))
    assert "Repartition 8" in plan(next(df for df, label, *_ in written if label == "lists"))
