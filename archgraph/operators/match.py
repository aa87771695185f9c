"""Resolution of references against identity forms.

A reference names a component by one of several tokens, most specific first;
each token can be read under several rules, strongest first. The first token
that anyone answers to decides, by its strongest rule, and an answer that is
not unique is refused, never guessed.

Shape of the plan. Candidates are never paired with references. Forms are
pre-aggregated to one row per (repo, form, reach) holding how many components
answer and, when that is one or two, which. ``reach`` says who may see them: a
scope inside a project, a whole project, or everyone (externals). References
that ask the same from the same place are one question; a question probes a
bounded number of those rows by equi-join, so a name shared by a third of all
components costs as much as any other name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions import ids, net
from archgraph.session import dealt, durable

# (rule, rank, penalty in hundredths, form kind it looks up)
Rules = list[tuple[str, int, int, str]]


def match_rules(extra: list[tuple[str, int, str]] | None = None) -> Rules:
    """The ladder, strongest rule first. ``extra`` adds weaker rules (rule,
    penalty, form kind); their forms are further rows of the forms table."""
    ladder = [(rule, int(pct), form) for rule, pct, form in vocab.rows(vocab.MATCH_RULES)] + (extra or [])
    return [(rule, rank, pct, form) for rank, (rule, pct, form) in enumerate(ladder)]


def hints_from_values(rows: DataFrame) -> DataFrame:
    """References in configuration values.

    ``rows``: repo, row_id, from_node, key, value, path, line. The raw value is
    kept masked only.
    """
    from archgraph.functions.redact import redact_value

    # short rows, alike, fill few files: read as they lie, a handful of tasks would parse them all
    refs = net.parse_references(dealt(rows), "key", "value")
    return refs.select(
        "repo", F.col("row_id").alias("hint_id"), "from_node", "path", "line",
        F.col("ref.kind").alias("kind"), redact_value(F.col("key"), F.col("value")).alias("raw"),
        F.col("ref.tokens").alias("tokens"), F.col("ref.port").alias("port"),
        F.col("ref.protocol").alias("protocol"), F.col("ref.edge").alias("suggested_edge"),
        F.concat(F.lit("env "), "key", F.lit("="), redact_value(F.col("key"), F.col("value"))).alias("detail"))


def _reach(kind: Column, project: Column, namespace: Column) -> Column:
    """Every reach a component is visible under, as lookup keys."""
    return F.when(kind == "external", F.array(F.lit("*"))).otherwise(F.array_compact(F.array(
        F.concat(F.lit("p|"), project),
        F.when(namespace != "", F.concat(F.lit("s|"), project, F.lit("|"), namespace)))))


def _own(forms: DataFrame, rules: Rules) -> DataFrame:
    """(repo, self_node, normed, form, mine): which rules a component itself answers to under a spelling, as bits."""
    bit = F.create_map(*[F.lit(x) for _, i, _, form in rules for x in (form, 1 << i)])
    kinds = [form for *_, form in rules]
    return forms.where(F.col("form_kind").isin(*kinds)).groupBy(
        "repo", F.col("node_id").alias("self_node"), (F.col("form_kind") == "norm").alias("normed"), "form").agg(
        F.sum(bit[F.col("form_kind")]).alias("mine"))


def _spellings(token: Column) -> Column:
    return F.explode(F.array(F.struct(F.lit(False).alias("normed"), F.lower(token).alias("form")),
                             F.struct(F.lit(True).alias("normed"), ids.normalize_name(token).alias("form"))))


def _asked(hints: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """Hints with where their component lives and the question they ask.

    Hints of one place that name the same thing ask the same question: it is
    decided once, however many ask. Only where a component answers to one of
    its own tokens does the question name it (``self_node``), so that it can be
    discounted; that is found by joining spellings, not by carrying forms.
    """
    referrer = nodes.select(
        "repo", F.col("id").alias("from_node"), F.col("namespace").alias("from_namespace"),
        F.col("project").alias("from_project"), F.col("kind").alias("from_kind"), F.col("ports").alias("from_ports"))
    named = hints.select("repo", "from_node", "tokens").distinct()
    spelled = named.select("*", F.explode("tokens").alias("token")).select(
        "repo", F.col("from_node").alias("self_node"), "tokens", _spellings(F.col("token")).alias("s")).select("repo", "self_node", "tokens", "s.*")
    selfish = spelled.join(own, ["repo", "self_node", "normed", "form"], "left_semi").select(
        "repo", F.col("self_node").alias("from_node"), "tokens", F.lit(True).alias("_self")).distinct()
    out = hints.join(referrer, ["repo", "from_node"]).join(selfish, ["repo", "from_node", "tokens"], "left")
    mine = lambda c: F.when(F.col("_self"), F.col(c))
    asks = {"port_asked": F.when(F.col("port") > 0, F.col("port")), "kind_asked": ids.kind_for_edge(F.col("suggested_edge")),
            "self_node": mine("from_node"), "self_kind": mine("from_kind"), "self_ports": mine("from_ports")}
    out = out.withColumns(asks).drop("_self", "from_kind", "from_ports")
    return out.withColumn("ask", F.md5(F.to_json(F.struct("tokens", "from_namespace", "from_project", *asks), {"ignoreNullFields": "false"})))


_QUESTION = ["repo", "ask", "tokens", "from_namespace", "from_project", "port_asked", "kind_asked", "self_node", "self_kind", "self_ports"]


def _answers(forms: DataFrame, nodes: DataFrame, rules: Rules) -> DataFrame:
    """Who answers to a form, per reach: how many, and the least and greatest
    id, with one array entry per rule."""
    rank = {form: i for _, i, _, form in rules}
    attrs = nodes.select("repo", F.col("id").alias("node_id"),
                         F.explode(_reach(F.col("kind"), F.col("project"), F.col("namespace"))).alias("reach"))
    per_rule = (
        forms.where(F.col("form_kind").isin(*rank))
        .join(attrs, ["repo", "node_id"])
        .groupBy("repo", "form_kind", "form", "reach")
        .agg(F.count("*").alias("n"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi")))
    normed = F.col("form_kind") == "norm"
    return per_rule.groupBy("repo", "reach", normed.alias("normed"), "form").agg(
        F.collect_list(F.struct("form_kind", "n", "lo", "hi")).alias("rules"))  # at most one entry per rule


def match_ladder(hints: DataFrame, nodes: DataFrame, forms: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Decide every hint: adds outcome, rule, node_id, match_pct, n_candidates
    and the deciding form (rule kind, form, reach), by which the candidates of
    a refusal can be listed.

    outcome: matched, ambiguous, out_of_scope or none.
    """
    rules = rules or match_rules()
    own = _own(forms, rules)
    asked = durable(_asked(hints, nodes, own), "asked")
    # read twice below: once for the ties, once for the result
    decided = durable(_decide(asked.select(*_QUESTION).distinct(), _answers(forms, nodes, rules), own, rules), "decided")
    answered = _tie_break(decided, nodes, forms, rules)
    out = asked.join(answered, ["repo", "ask"])
    return out.select(
        "repo", "hint_id", "from_node", "kind", "raw", "tokens", "port", "protocol", "suggested_edge", "path", "line", "detail",
        "from_namespace", "from_project", "outcome", "rule", "node_id",
        F.when(F.col("outcome") == "matched", ids.base_confidence(F.col("kind")) - F.col("penalty")).cast("int").alias("match_pct"),
        "n_candidates", "form_kind", "form", "reach")


def _decide(questions: DataFrame, answers: DataFrame, own: DataFrame, rules: Rules) -> DataFrame:
    scoped = F.col("from_namespace") != ""
    reaches = F.array_compact(F.array(
        F.lit("*"), F.concat(F.lit("p|"), "from_project"),
        F.when(scoped, F.concat(F.lit("s|"), "from_project", F.lit("|"), "from_namespace"))))
    spelled = (questions.select("repo", "ask", "self_node", scoped.alias("scoped"), (F.col("self_kind") == "external").alias("outer"),
                                reaches.alias("reaches"), F.posexplode("tokens").alias("pos", "token"))
               .select("*", _spellings(F.col("token")).alias("s")).select("*", "s.*").drop("s", "token"))
    # the referrer itself is never an answer: which rules it answers to under a spelling is noted as bits
    mine = spelled.where("self_node IS NOT NULL").join(own, ["repo", "self_node", "normed", "form"], "left").withColumn(
        "mine", F.coalesce("mine", F.lit(0)).cast("bigint"))
    spelled = mine.unionByName(spelled.where("self_node IS NULL").withColumn("mine", F.lit(0).cast("bigint")))
    probes = spelled.select("repo", "ask", "scoped", "outer", "pos", "normed", "form", "mine", F.explode("reaches").alias("reach"))
    rank = F.create_map(*[x for _, i, _, form in rules for x in (F.lit(form), F.lit(i))])
    bit = F.create_map(*[F.lit(x) for _, i, _, form in rules for x in (form, 1 << i)])
    discount = F.coalesce((F.col("mine").bitwiseAND(bit[F.col("r.form_kind")]) > 0) & ((F.col("reach") == "*") == F.col("outer")),
                          F.lit(False)).cast("int")
    hits = (
        probes.join(answers, ["repo", "reach", "normed", "form"])
        .select("repo", "ask", "scoped", "pos", "form", "reach", "mine", "outer", F.explode("rules").alias("r"))
        .select("repo", "ask", "scoped", "pos", "form", "reach", "mine", F.col("r.form_kind").alias("form_kind"),
                rank[F.col("r.form_kind")].alias("rule_rank"), (F.col("r.n") - discount).alias("n"),
                "r.lo", "r.hi", discount.alias("own"))
        .where("n > 0"))
    local = F.col("reach").startswith("s|") | (F.col("reach") == "*")
    wide = ~F.col("reach").startswith("s|")
    per_rule = hits.groupBy("repo", "ask", "pos", "scoped", "rule_rank", "form_kind", "form").agg(
        (F.max("mine").bitwiseAND(bit[F.col("form_kind")]) > 0).alias("owned"),
        *[F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0)).alias(f"n_{tag}") for tag, flag in (("local", local), ("wide", wide))],
        *[F.min(F.when(flag, F.struct("n", "lo", "hi", "own"))).alias(f"one_{tag}") for tag, flag in (("local", local), ("wide", wide))])
    ranked = per_rule.select(
        "repo", "ask", "scoped", "form_kind", "form", "owned",
        F.explode(F.array(
            F.struct("pos", F.lit(0).alias("is_wide"), "rule_rank", F.col("n_local").alias("n"), F.col("one_local").alias("one")),
            F.struct("pos", F.lit(1).alias("is_wide"), "rule_rank", F.col("n_wide").alias("n"), F.col("one_wide").alias("one")))).alias("c"),
    ).where("c.n > 0")
    # a reference without a scope has no local reading, only the whole project
    return questions.drop("tokens").join(
        ranked.where("scoped OR c.is_wide = 1")
        .groupBy("repo", "ask")
        .agg(F.min_by(F.struct("c.*", "form_kind", "form", "owned"), F.struct("c.pos", "c.is_wide", "c.rule_rank")).alias("best")),
        ["repo", "ask"], "left")


def _tie_break(decided: DataFrame, nodes: DataFrame, forms: DataFrame, rules: Rules) -> DataFrame:
    """Narrow a tied answer by namespace, then port, then implied kind, each
    only if somebody is left; count candidates per narrowing key, never list."""
    rule_name = F.create_map(*[x for rule, i, _, _ in rules for x in (F.lit(i), F.lit(rule))])
    penalty = F.create_map(*[x for _, i, pct, _ in rules for x in (F.lit(i), F.lit(pct))])
    scoped = F.col("from_namespace") != ""
    d = decided.select(
        "*", F.col("best.n").alias("n_candidates"), F.col("best.rule_rank").alias("rule_rank"), F.col("best.owned").alias("owned"),
        F.coalesce((F.col("best.is_wide") == 1) & scoped, F.lit(False)).alias("outside"),
        F.col("best.form_kind").alias("form_kind"), F.col("best.form").alias("form"),
        F.when(F.col("best.is_wide") == 0, F.concat(F.lit("s|"), "from_project", F.lit("|"), "from_namespace"))
        .when(F.col("best.is_wide") == 1, F.concat(F.lit("p|"), "from_project")).alias("reach"),
        # two ids are known per counted group; with the referrer discounted
        # from a pair, the other one remains
        F.when(F.col("best.n") == 1, F.when(
            (F.col("best.one.own") == 1) & (F.col("best.one.lo") == F.col("self_node")), F.col("best.one.hi"))
            .otherwise(F.col("best.one.lo"))).alias("single"),
    ).drop("best")
    tied = d.where((F.col("n_candidates") > 1) & ~F.col("outside"))
    narrowed = _narrow(tied, nodes, forms)
    out = d.join(narrowed, ["repo", "ask"], "left")
    matched = (F.col("n_candidates") == 1) & ~F.col("outside")
    by_scope = F.col("narrow_id").isNotNull()
    return out.select(
        "repo", "ask",
        F.when(matched | by_scope, F.lit("matched"))
        .when(F.col("n_candidates").isNull(), F.lit("none"))
        .when(F.col("n_candidates") > 1, F.lit("ambiguous")).otherwise("out_of_scope").alias("outcome"),
        F.concat(rule_name[F.col("rule_rank")], F.when(by_scope, F.lit("+scoped")).otherwise("")).alias("rule"),
        F.when(matched, F.col("single")).otherwise(F.col("narrow_id")).alias("node_id"),
        (penalty[F.col("rule_rank")] + F.when(matched, F.lit(0)).otherwise(vocab.SCOPED_PENALTY)).alias("penalty"),
        F.coalesce("n_candidates", F.lit(0)).cast("int").alias("n_candidates"),
        "form_kind", "form", "reach")


def _narrow(tied: DataFrame, nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """(repo, ask, narrow_id) for ties that narrow to one candidate.

    Tied forms are counted once per combination of the three narrowing
    signals ('' = not used); a question then probes at most seven combinations.
    """
    any_ = F.lit("")
    keys = tied.select("repo", "form_kind", "form").distinct()
    attrs = nodes.select(
        "repo", F.col("id").alias("node_id"), F.explode(_reach(F.col("kind"), F.col("project"), F.col("namespace"))).alias("reach"),
        F.col("namespace").alias("ns"), F.col("ports").alias("ports"), F.col("kind").alias("nk"))
    counted = (
        forms.join(keys, ["repo", "form_kind", "form"], "left_semi").join(attrs, ["repo", "node_id"])
        .select("repo", "form_kind", "form", "reach", "node_id",
                F.explode(F.array(any_, F.concat(F.lit("n"), "ns"))).alias("by_ns"), "ports", "nk")
        .select("repo", "form_kind", "form", "reach", "node_id", "by_ns",
                F.explode(F.concat(F.array(any_), F.transform(F.array_distinct("ports"), lambda p: p.cast("string")))).alias("by_port"), "nk")
        .select("repo", "form_kind", "form", "reach", "node_id", "by_ns", "by_port",
                F.explode(F.array(any_, F.col("nk"))).alias("by_kind"))
        .groupBy("repo", "form_kind", "form", "reach", "by_ns", "by_port", "by_kind")
        .agg(F.count("*").alias("n"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi")))
    ns = F.when(F.col("from_namespace") != "", F.concat(F.lit("n"), "from_namespace"))
    port, kind = F.col("port_asked").cast("string"), F.col("kind_asked")
    combos = F.array(*[
        F.struct(F.lit(tag).alias("tag"), (ns if "n" in tag else any_).alias("by_ns"),
                 (port if "p" in tag else any_).alias("by_port"), (kind if "k" in tag else any_).alias("by_kind"))
        for tag in ("n", "p", "k", "np", "nk", "pk", "npk")])
    probes = (
        tied.select("repo", "ask", "form_kind", "form", "from_namespace", "self_node", "self_kind", "self_ports", "owned", "reach",
                    F.explode(combos).alias("c"))
        .where("c.by_ns IS NOT NULL AND c.by_port IS NOT NULL AND c.by_kind IS NOT NULL")
        .withColumn("reach", F.explode(F.array("reach", F.lit("*"))))
        .select("*", "c.*").drop("c"))
    own = F.coalesce(
        F.col("owned")
        & ((F.col("reach") == "*") == (F.col("self_kind") == "external"))
        & ((F.col("by_ns") == "") | (F.col("by_ns") == F.concat(F.lit("n"), "from_namespace")))
        & ((F.col("by_port") == "") | F.array_contains(F.transform("self_ports", lambda p: p.cast("string")), F.col("by_port")))
        & ((F.col("by_kind") == "") | (F.col("by_kind") == F.col("self_kind"))), F.lit(False)).cast("int")
    found = (
        probes.join(counted, ["repo", "form_kind", "form", "reach", "by_ns", "by_port", "by_kind"])
        .select("repo", "ask", "tag", (F.col("n") - own).alias("n"),
                F.when((own == 1) & (F.col("lo") == F.col("self_node")), F.col("hi")).otherwise(F.col("lo")).alias("id"))
        .where("n > 0")
        .groupBy("repo", "ask", "tag").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
        .groupBy("repo", "ask").agg(F.map_from_entries(F.collect_list(
            F.struct("tag", F.struct("n", "id")))).alias("m")))  # at most seven entries
    m = F.col("m")

    def at(tag: Column) -> Column:
        return F.try_element_at(m, tag)

    # narrowing is sequential: a signal is used only where it leaves somebody
    step = found.withColumn("t1", F.when(at(F.lit("n")).isNotNull(), F.lit("n")).otherwise(""))
    step = step.withColumn("t2", F.when(at(F.col("t1"))["n"] == 1, F.col("t1"))
                           .when(at(F.concat("t1", F.lit("p"))).isNotNull(), F.concat("t1", F.lit("p"))).otherwise(F.col("t1")))
    step = step.withColumn("t3", F.when(at(F.col("t2"))["n"] == 1, F.col("t2"))
                           .when(at(F.concat("t2", F.lit("k"))).isNotNull(), F.concat("t2", F.lit("k"))).otherwise(F.col("t2")))
    return step.where(at(F.col("t3"))["n"] == 1).select("repo", "ask", at(F.col("t3"))["id"].alias("narrow_id"))


# ------------------------------------------------------------ candidate filters
def in_scope(kind: Column, namespace: Column, scope: Column) -> Column:
    return (kind == "external") | (namespace == scope)


def in_project(kind: Column, node_project: Column, project: Column) -> Column:
    return (project == "") | (kind == "external") | (node_project == project)


def in_namespace(namespace: Column, wanted: Column) -> Column:
    return namespace == wanted


def on_port(ports: Column, port: Column) -> Column:
    return F.array_contains(ports, port)


def of_kind(kind: Column, wanted: Column) -> Column:
    return kind == wanted


def without_self(id_: Column, kind: Column, project: Column, self_id: Column, self_project: Column) -> Column:
    """Not the referrer, not a boundary, not another project's component."""
    return (id_ != self_id) & (kind != "boundary") & ((kind == "external") | (project == self_project))


# ---------------------------------------------------------------- what follows
def refusal_candidates(decisions: DataFrame, nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """Who answered to a refused form: one row per (form, reach, component),
    once per form however many hints were refused by it. Joined to the
    refusals by (repo, form_kind, form, reach) it lists every candidate."""
    keys = decisions.where(F.col("outcome").isin("ambiguous", "out_of_scope")).select(
        "repo", "form_kind", "form", F.explode(F.array("reach", F.lit("*"))).alias("seen"), "reach").distinct()
    attrs = nodes.select(
        "repo", F.col("id").alias("node_id"), ids.display_name(F.col("name"), F.col("namespace")).alias("label"),
        F.explode(_reach(F.col("kind"), F.col("project"), F.col("namespace"))).alias("seen"))
    return (forms.join(attrs, ["repo", "node_id"])
            .join(keys, ["repo", "form_kind", "form", "seen"])
            .select("repo", "form_kind", "form", "reach", "node_id", "label"))


def refusal_diagnostics(decisions: DataFrame, nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """One diagnostic per refused or unanswered hint.

    A message names at most the eight first candidates and counts the others;
    ``refusal_candidates`` holds all of them.
    """
    from pyspark.sql import Window

    listed = refusal_candidates(decisions, nodes, forms)
    w = Window.partitionBy("repo", "form_kind", "form", "reach").orderBy("label", "node_id")
    # nine, because the referrer itself may be among them
    first = (listed.withColumn("rn", F.row_number().over(w)).where("rn <= 9")
             .groupBy("repo", "form_kind", "form", "reach")
             .agg(F.array_sort(F.collect_list(F.struct("label", "node_id"))).alias("first")))
    names = nodes.select("repo", F.col("id").alias("from_node"),
                         ids.display_name(F.col("name"), F.col("namespace")).alias("from_name"))
    refused = (decisions.where("outcome <> 'matched'")
               .join(first, ["repo", "form_kind", "form", "reach"], "left")
               .join(names, ["repo", "from_node"]))
    shown = F.slice(F.filter("first", lambda c: c["node_id"] != F.col("from_node"))["label"], 1, 8)
    listing = F.concat(F.array_join(shown, ", "), F.when(
        F.col("n_candidates") > 8, F.concat(F.lit(" and "), F.col("n_candidates") - 8, F.lit(" more"))).otherwise(""))
    host = F.try_element_at("tokens", F.lit(1))
    unresolved = F.col("outcome") == "none"
    return refused.where(~unresolved | ~net.is_external_host(host)).select(
        "repo", "hint_id",
        F.when(F.col("outcome") == "ambiguous", F.lit("warn")).otherwise("info").alias("severity"),
        F.when(unresolved, F.lit("unresolved_reference")).when(F.col("outcome") == "ambiguous", F.lit("ambiguous_reference"))
        .otherwise("out_of_scope_reference").alias("code"),
        "path", "line",
        F.when(unresolved, F.concat(F.lit('"'), "from_name", F.lit('" refers to "'), host,
                                    F.lit('", which matches no component')))
        .when(F.col("outcome") == "ambiguous", F.concat(
            F.lit('"'), "raw", F.lit('" matches '), F.col("n_candidates"), F.lit(" components ("), listing, F.lit(")")))
        .otherwise(F.concat(F.lit('"'), "raw", F.lit('" matches only '), listing, F.lit(' outside "'),
                            "from_namespace", F.lit('"'))).alias("message"))


def _extractor(decisions: DataFrame) -> Column:
    """The job a reference came from, where the decisions still know it."""
    return F.col("extractor") if "extractor" in decisions.columns else F.lit("resolver").alias("extractor")


def resolved_edges(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of matched hints, one row per piece of evidence."""
    target = nodes.select("repo", F.col("id").alias("node_id"), F.col("kind").alias("target_kind"),
                          F.col("name").alias("target_name"))
    return decisions.where("outcome = 'matched'").join(target, ["repo", "node_id"]).select(
        "repo", F.col("from_node").alias("src"), F.col("node_id").alias("dst"),
        ids.edge_kind_for(F.col("suggested_edge"), F.col("target_kind")).alias("kind"), "protocol",
        F.col("match_pct").alias("conf_pct"), "rule", "path", "line",
        F.concat("detail", F.lit(" (resolves to "), "target_name", F.lit(")")).alias("detail"), _extractor(decisions))


def external_synthesis(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for hosts nobody declares: one external per host.

    The host's first hint, in (from, path, line, raw, detail) order, carries the rule
    that made the component; later ones found it by name.
    """
    host = F.try_element_at("tokens", F.lit(1))
    unmatched = decisions.where("outcome = 'none'").withColumn("host", host).where(
        net.is_external_host(F.col("host")))
    order = F.struct("from_node", "path", "line", "raw", "detail", "hint_id")
    first = unmatched.groupBy("repo", "host").agg(F.min(order).alias("first"))
    id_ = ids.node_id(F.lit("external"), F.lit(""), F.col("host"))
    nodes = first.select("repo", id_.alias("id"), F.lit("external").alias("kind"), F.lit("context").alias("layer"),
                         F.col("host").alias("name"), F.lit("net").alias("namespace"),
                         F.col("first.path").alias("path"), F.col("first.line").alias("line"), F.lit(80).alias("conf_pct"))
    edges = unmatched.join(first, ["repo", "host"]).select(
        "repo", F.col("from_node").alias("src"), id_.alias("dst"),
        ids.edge_kind_for(F.col("suggested_edge"), F.lit("external")).alias("kind"), "protocol",
        ids.base_confidence(F.col("kind")).alias("conf_pct"),
        F.when(F.col("hint_id") == F.col("first.hint_id"), F.lit("external_host")).otherwise("dns_exact").alias("rule"),
        "path", "line", F.concat("detail", F.lit(" (resolves to "), "host", F.lit(")")).alias("detail"), _extractor(decisions))
    return nodes, edges
