"""SQL pieces for the DuckDB side only. They restate each rule in plain SQL,
without the Spark code's shortcuts, so that the comparison means something."""

from __future__ import annotations

from archgraph import vocab


def values(text_rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(
        str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for v in row) + ")"
        for row in text_rows)
    return f"SELECT * FROM (VALUES {body}) t({names})"


def in_list(text: str) -> str:
    return ", ".join(f"'{w}'" for w in vocab.words(text))


def alt(text: str) -> str:
    return "|".join(vocab.words(text)).replace(".", r"\.")


PIECES: dict[str, str] = {}

PIECES["dk_schemes"] = values(vocab.rows(vocab.SCHEMES), "scheme, protocol, edge, dport")
PIECES["dk_ports"] = values(vocab.rows(vocab.PORT_CONVENTIONS), "port, protocol, edge")
PIECES["dk_images"] = values(vocab.rows(vocab.IMAGES), "name, kind, tech")
PIECES["dk_languages"] = values(vocab.rows(vocab.BASE_IMAGE_LANGUAGES), "name, language")
PIECES["dk_libraries"] = values(vocab.rows(vocab.LIBRARIES), "dep, tech, kind, edge")
PIECES["dk_frameworks"] = values(vocab.rows(vocab.FRAMEWORKS), "dep, framework")
PIECES["dk_resources"] = values(vocab.rows(vocab.RESOURCE_TYPES), "type, kind, tech")
PIECES["dk_plumbing"] = values([(w,) for w in vocab.words(vocab.PLUMBING_PREFIXES)], "prefix")
PIECES["dk_base"] = values([(k, int(p)) for k, p in vocab.rows(vocab.BASE_CONFIDENCE)], "kind, pct")
PIECES["dk_rules"] = values(
    [(r, i, int(p), f) for i, (r, p, f) in enumerate(vocab.rows(vocab.MATCH_RULES))],
    "rule, rule_rank, penalty, form_kind")

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def reference_key(k: str) -> str:
    return (f"(upper({k}) IN ({in_list(vocab.REFERENCE_KEYS)}) OR "
            f"regexp_matches(upper({k}), '({alt(vocab.REFERENCE_KEY_SUFFIXES)})$'))")


def plausible(h: str) -> str:
    return (f"(regexp_full_match({h}, '[A-Za-z0-9._-]+') AND regexp_matches({h}, '[A-Za-z]') "
            f"AND strlen({h}) <= 253 AND lower({h}) NOT IN ({in_list(vocab.NON_HOSTS)}))")


def public_suffix(x: str) -> str:
    return f"(strlen({x}) = 2 OR {x} IN ({in_list(vocab.PUBLIC_SUFFIXES)}))"


def external_host(h: str) -> str:
    last = f"string_split({h}, '.')[-1]"
    return (f"(contains({h}, '.') AND {last} NOT IN ({in_list(vocab.INTERNAL_SUFFIXES)}) "
            f"AND {public_suffix(last)})")


def valid_port(p: str) -> str:
    n = f"try_cast({p} AS BIGINT)"
    return (f"CASE WHEN regexp_full_match({p}, '\\+?[0-9]+') AND {n} BETWEEN 1 AND 65535 "
            f"THEN {n}::INTEGER END")


def tokens(h: str) -> str:
    """List of host tokens; ``h`` must be a column name."""
    full = f"lower(regexp_replace({h}, '\\.$', ''))"
    inner = ("regexp_replace(regexp_replace(regexp_replace(" + full
             + ", '\\.svc\\.cluster\\.local$', ''), '\\.cluster\\.local$', ''), '\\.svc$', '')")
    labels = f"string_split({inner}, '.')"
    shorter = (f"CASE WHEN len({labels}) > 1 AND NOT {public_suffix(labels + '[-1]')} THEN "
               f"list_transform(range(len({labels}) - 1, 0, -1), lambda n: array_to_string({labels}[1:n], '.')) "
               "ELSE [] END")
    everything = f"list_concat([{full}, {inner}], {shorter})"
    # keep first occurrences, in order
    return (f"list_filter({everything}, lambda t, i: t <> '' AND list_position({everything}, t) = i)")


def hints(source: str) -> dict[str, str]:
    """dk_ref: rows of ``source`` (columns row_id, key, value, ...) that parse
    as a reference, with kind, tokens, port, protocol, edge."""
    pick = (f"list_filter(list_transform(string_split(v, ','), lambda p: {trim('p')}), "
            f"lambda p: {plausible('regexp_replace(regexp_replace(p, ' + chr(39) + '^([^:]*):[^:]*$' + chr(39) + ', ' + chr(39) + chr(92) + '1' + chr(39) + '), ' + chr(39) + chr(92) + '.$' + chr(39) + ', ' + chr(39) + chr(39) + ')')})[1]")
    return {
        "dk_ref0": f"SELECT *, {trim('value')} AS v FROM {{{source}}}",
        "dk_ref1": r"""
            SELECT *, regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)', 1) AS scheme,
                   regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)', 2) AS auth
            FROM {dk_ref0} WHERE v <> '' AND NOT contains(v, chr(36) || '{') AND NOT contains(v, chr(36) || '(')""",
        "dk_ref2": r"""
            SELECT *, regexp_extract(auth, '([^@]*)$', 1) AS addr FROM {dk_ref1}""",
        "dk_ref3": r"""
            SELECT *, CASE WHEN contains(addr, ':') THEN
                   CASE WHEN regexp_matches(addr, ':[0-9]*$') THEN regexp_replace(addr, ':[0-9]*$', '') END
                   ELSE addr END AS uhost,
                   regexp_extract(addr, ':([0-9]*)$', 1) AS uport FROM {dk_ref2}""",
        "dk_ref4": f"""
            SELECT r.*, s.protocol AS sproto, s.edge AS sedge, s.dport,
                   coalesce(s.scheme IS NOT NULL AND {plausible('uhost')}, false) AS is_url,
                   CASE WHEN contains(v, ',') THEN {pick} ELSE v END AS part
            FROM {{dk_ref3}} r LEFT JOIN {{dk_schemes}} s ON s.scheme = lower(r.scheme)""",
        "dk_ref5": r"""
            SELECT *, regexp_replace(CASE WHEN regexp_full_match(part, '[^:]*:[^:]*')
                        THEN string_split(part, ':')[1] ELSE part END, '\.$', '') AS phost,
                   CASE WHEN regexp_full_match(part, '[^:]*:[^:]*') THEN string_split(part, ':')[2] ELSE '' END AS pport
            FROM {dk_ref4}""",
        "dk_ref": f"""
            SELECT r.* EXCLUDE (scheme, auth, addr, uhost, uport, sproto, sedge, dport, part, phost, pport, v),
                   CASE WHEN NOT is_url THEN 'env_host' WHEN sedge IN ('persists_to', 'publishes_to')
                        THEN 'conn_string' ELSE 'env_url' END AS kind,
                   CASE WHEN is_url THEN {tokens('uhost')} ELSE {tokens('phost')} END AS tokens,
                   CASE WHEN is_url THEN coalesce({valid_port('uport')}, dport::INTEGER)
                        ELSE coalesce({valid_port('pport')}, 0) END AS port,
                   CASE WHEN is_url THEN sproto ELSE coalesce(p.protocol, '') END AS protocol,
                   CASE WHEN is_url THEN sedge ELSE coalesce(p.edge, 'calls') END AS edge
            FROM {{dk_ref5}} r LEFT JOIN {{dk_ports}} p ON p.port = coalesce({valid_port('pport')}, 0)::VARCHAR
            WHERE is_url OR ({reference_key('key')} AND {plausible('phost')})""",
    } | PIECES


def slug_segment(x: str) -> str:
    folded = f"trim(regexp_replace(lower({trim(x)}), '[^a-z0-9._]+', '-', 'g'), '-.')"
    return f"CASE WHEN {folded} = '' THEN 'unknown' ELSE {folded} END"


def slug_path(x: str) -> str:
    folded = f"regexp_replace(lower({trim(x)}), '[^a-z0-9._/]+', '-', 'g')"
    joined = (f"array_to_string(list_filter(list_transform(string_split({folded}, '/'), "
              "lambda p: trim(p, '-.')), lambda p: p <> ''), '/')")
    return f"CASE WHEN {joined} = '' THEN 'unknown' ELSE {joined} END"


def name_slug(x: str) -> str:
    lossy = rf"regexp_matches(regexp_replace({x}, '[\x00-\x7F]', '', 'g'), '[\p{{L}}\p{{Nd}}]')"
    return (f"(CASE WHEN {trim(x)} <> '' AND {lossy} THEN ({slug_path(x)}) || '.' || "
            f"substr(sha256({trim(x)}), 1, 8) ELSE {slug_path(x)} END)")


def node_id(kind: str, scope: str, name: str) -> str:
    return (f"CASE WHEN {kind} IN ('boundary', 'external') THEN 'context' ELSE 'container' END || ':' || "
            f"CASE WHEN coalesce({trim(scope)}, '') <> '' THEN '@' || ({slug_segment(scope)}) || '/' ELSE '' END || "
            f"{name_slug(name)}")


def edge_id(src: str, dst: str, kind: str, protocol: str) -> str:
    return (f"'e:' || substr(sha256({src} || chr(0) || {dst} || chr(0) || {kind} || chr(0) || "
            f"coalesce({protocol}, '')), 1, 12)")


def redact(x: str) -> str:
    out = f"regexp_replace({x}, '{vocab.PEM_PATTERN}', '{vocab.PEM_MASK}', 'g')"
    out = f"regexp_replace({out}, '{vocab.URL_USERINFO_PATTERN}', '\\1***:***@', 'g')"
    out = rf"regexp_replace({out}, '\b{vocab.AWS_KEY_PATTERN}\b', '***', 'g')"
    out = rf"regexp_replace({out}, '\b{vocab.PREFIXED_TOKEN_PATTERN}', '***', 'g')"
    return rf"regexp_replace({out}, '\b{vocab.JWT_PATTERN}', '***', 'g')"


def secret_key(k: str) -> str:
    upper = rf"regexp_replace(upper({trim(k)}), '[^\p{{L}}\p{{Nd}}]', '_', 'g')"
    segs = rf"regexp_replace({upper}, '(\p{{Nd}})(\p{{Lu}})', '\1_\2', 'g')"
    return (f"(NOT regexp_matches({upper}, '(^|_)({alt(vocab.SECRET_KEY_EXCEPTIONS)})$') AND ("
            f"regexp_matches({upper}, '{alt(vocab.SECRET_KEY_SUBSTRINGS)}') OR "
            f"regexp_matches({segs}, '(^|_)({alt(vocab.SECRET_KEY_SEGMENTS)})(_|$)')))")


def redact_value(k: str, x: str) -> str:
    return f"CASE WHEN {x} = '' THEN {x} WHEN {secret_key(k)} THEN '***' ELSE {redact(x)} END"


def image(ref: str) -> dict[str, str]:
    """Expressions for the parts of an image reference."""
    text = trim(ref)
    tagged = f"string_split({text}, '@')[1]"
    bare = f"regexp_replace({tagged}, ':[^:/]*$', '')"
    head = f"CASE WHEN contains({bare}, '/') THEN string_split({bare}, '/')[1] ELSE '' END"
    is_reg = f"(regexp_matches({head}, '[.:]') OR {head} = 'localhost')"
    repo = f"CASE WHEN {is_reg} THEN regexp_replace({bare}, '^[^/]*/', '') ELSE {bare} END"
    return {
        "registry": f"CASE WHEN {is_reg} THEN {head} ELSE '' END",
        "repository": repo,
        "name": f"string_split({repo}, '/')[-1]",
        "tag": f"regexp_extract({tagged}, ':([^:/]*)$', 1)",
        "digest": f"CASE WHEN contains({text}, '@') THEN regexp_extract({text}, '^[^@]*@(.*)$', 1) ELSE '' END",
    }


def variants(name: str) -> str:
    """Lower-cased name, prefix-less name, suffix-less names, in order."""
    base = f"lower({name})"
    short = f"regexp_replace({base}, '^({alt(vocab.IMAGE_PREFIXES)})', '')"
    cuts = ", ".join(f"CASE WHEN ends_with({short}, '{s}') THEN {short}[:-{len(s) + 1}] END"
                     for s in vocab.words(vocab.IMAGE_SUFFIXES))
    return f"list_filter([{base}, {short}, {cuts}], lambda v: v IS NOT NULL)"


def norm_dep(d: str) -> str:
    t = trim(d)
    t = f"regexp_replace({t}, '^([^\\[]+)\\[.*$', '\\1')"
    t = f"regexp_replace({t}, '^(.+)/v[0-9]+$', '\\1')"
    return (f"CASE WHEN contains({t}, '/') AND NOT starts_with({t}, '@') THEN {t} "
            f"ELSE lower(replace({t}, '_', '-')) END")


def clean_path(p: str) -> str:
    segs = f"list_filter(string_split({p}, '/'), lambda s: s <> '' AND s <> '.')"
    step = r"""CASE WHEN s = '..' AND acc <> '' AND NOT regexp_matches(acc, '(^|/)\.\.$')
               THEN regexp_replace(acc, '(^|/)[^/]*$', '')
               WHEN s = '..' AND starts_with(""" + p + r""", '/') THEN acc
               WHEN acc = '' THEN s ELSE acc || '/' || s END"""
    joined = f"CASE WHEN starts_with({p}, '/') THEN '/' ELSE '' END || list_reduce(list_prepend('', {segs}), lambda acc, s: {step})"
    return f"CASE WHEN ({joined}) = '' THEN '.' ELSE ({joined}) END"
