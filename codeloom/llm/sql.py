"""DuckDB SQL for operators 1, 8, 9 and 10: the same results written another way."""

from __future__ import annotations

from codeloom.llm import licenses as L
from codeloom.llm import quality as Q
from codeloom.llm import secrets as S

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def op1() -> str:
    digit = f"substr('{BASE32}', ((('0x' || substr(h, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\\x09-\\x0D\\x20]+', '', 'g') AS uri, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, list_reduce(list_transform(range(0, 32), lambda k: {digit}), lambda a, b: a || b) AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, uri,
  CASE WHEN first IS NULL OR first = page_id THEN greatest(1, ceil(n / 1048576.0))::BIGINT ELSE 1::BIGINT END AS n_chunks
FROM p JOIN f USING (h)
"""


def op8() -> str:
    """Patterns are written out here in DuckDB's dialect; only the known texts and digests are those of the operator."""
    owned = "(?m)^[ \\t#*/;%-]*((copyright|\\(c\\)|©)[ \\t:,]*((\\(c\\)|©|copyright|by)[ \\t:,]*)*[\\[<{(]*(\\d{4}|yyyy|year)|copyright[ \\t]*(\\(c\\)|©|:)|©|copyright.*all rights reserved|all rights reserved[.]?[ \\t\\r]*$).*$"
    same = {
        "licence": "license", "sub license": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog", "behaviour": "behavior", "favour": "favor", "fulfilment": "fulfillment", "organisation": "organization",
        "utilisation": "utilization", "whilst": "while", "wilful": "willful", "non commercial": "noncommercial", "per cent": "percent", "owner": "holder", "https ": "http ",
    }
    gap = "[\\x09-\\x0D\\x20\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E\\x{201C}\\x{201D}\\x{2018}\\x{2019}\\x{2013}\\x{2014}\\x{A9}]+"

    def canon(x: str) -> str:
        out = f"trim(regexp_replace(regexp_replace(lower({x}), '{owned}', '', 'g'), '{gap}', ' ', 'g'))"
        for found, written in same.items():
            out = f"replace({out}, '{found}', '{written}')"
        return out

    quoted = lambda x: x.replace("'", "''")
    texts = ", ".join(f"('{k}', '{quoted(v)}')" for k, v in L.variants())
    digests = ", ".join(f"('{k}', '{d}')" for k, ds in L.DIGESTS.items() for d in ds)
    speaks = "regexp_matches(lower({}), 'licen[cs]e|warranty|copyright|public domain')"
    return f"""
WITH known AS (SELECT digest, min(id) AS license FROM (SELECT id, sha256({canon("body")}) AS digest FROM (VALUES {texts}) AS k(id, body) UNION ALL SELECT * FROM (VALUES {digests}) AS g(id, digest)) GROUP BY 1),
lines AS (SELECT doc_id, sha256({canon("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE {speaks.format("text")}) WHERE {speaks.format("line")}),
found AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS notices FROM lines JOIN known USING (digest) GROUP BY doc_id),
docs AS (SELECT doc_id, sha256({canon("coalesce(text, '')")}) AS digest FROM documents)
SELECT d.doc_id, d.digest AS canonical_sha256, k.license, coalesce(f.n, 0)::BIGINT AS n_notices, coalesce(f.notices, '') AS notices
FROM docs d LEFT JOIN known k USING (digest) LEFT JOIN found f ON f.doc_id = d.doc_id
"""


def op9(alpha: float = 0.02, delta: float = 0.05) -> str:
    space = "[\\x20\\x09-\\x0D]"
    ratio = {name: value.replace(" / ", "::DOUBLE / ", 1) for name, (value, _) in Q.RULES.items()}
    hits = ", ".join(f"count(*) FILTER (WHERE {' OR '.join(f'{ratio[name]} > {cuts[j]}' for name, (_, cuts) in Q.RULES.items())}) AS k{j}" for j in range(10))

    def certified(j: int) -> str:
        k = f"k{j}"
        terms = f"list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i < 2 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN n - i < 2 THEN 0 ELSE lgamma(n - i + 1) END + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))))"
        return f"CASE WHEN {k} > n * {alpha} THEN 1.0 WHEN n = 1 THEN CASE WHEN {k} = 0 THEN 1 - {alpha} ELSE 1.0 END ELSE {terms} END <= {delta}::DOUBLE * n / total"

    level = "CASE " + " ".join(f"WHEN {certified(j)} THEN {j}" for j in range(10)) + " END AS level"
    failed = ", ".join(f"CASE WHEN NOT base_failed AND {ratio[name]} > {cuts}[level + 1] THEN '{name}' END" for name, (_, cuts) in Q.RULES.items())
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
twins AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twins) GROUP BY doc_id),
m AS (SELECT words.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM words LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
c AS (SELECT lang, count(*) AS n, {hits} FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY lang),
cuts AS (SELECT lang, {level} FROM c, (SELECT sum(n) AS total FROM c)),
j AS (SELECT b.*, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed FROM b LEFT JOIN cuts ON b.lang IS NOT DISTINCT FROM cuts.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND len(failed) = 0) AS kept, array_to_string(failed, ',') AS failed_rules FROM j
"""


def op10(max_owners: int = 1, max_repositories: int = 3) -> str:
    quoted = lambda p: p.replace("'", "''")

    def spans(pattern: str, kind: str, keep: str) -> str:
        p = quoted(pattern)
        return f"""SELECT doc_id, owner, repo, {kind} AS k, s, s + length(m) AS e, m FROM (
  SELECT doc_id, owner, repo, ms[i] AS m, (length(array_to_string(gaps[1:i], '')) + length(array_to_string(ms[1:i - 1], ''))) AS s FROM (
    SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, owner, repo, regexp_extract_all(t, '{p}', 0) AS ms, string_split_regex(t, '{p}') AS gaps FROM d))) WHERE {keep}"""

    kinds = "CASE WHEN starts_with(m, '-----BEGIN') THEN 3 WHEN regexp_matches(m, '^gh[pousr]_') THEN 4 WHEN starts_with(m, 'sk-') THEN 5 WHEN regexp_matches(m, '^xox[abprs]-') THEN 6 WHEN regexp_matches(m, '^eyJ[^.]+\\.eyJ') THEN 7 WHEN regexp_matches(m, '^AIza') THEN 8 ELSE 9 END"
    looks = f"({kinds} <> 9 OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND NOT regexp_matches(m, '(?i)example|sample|dummy|xxxx|1234567')))"
    names = "[" + ", ".join(f"'{k}'" for k in S.KINDS) + "]"
    shown = f"{names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, source AS owner, concat_ws('/', source, lang) AS repo FROM documents),
base AS ({spans(S.ASSIGN, "0", f"length(regexp_extract(m, '{quoted(S.ASSIGN)}', 2)) >= 12")}
UNION ALL {spans(S.ACCESS, "1", "length(m) >= 18")}
UNION ALL {spans(S.HEX, "2", "true")}),
more AS (SELECT * FROM ({spans(S.MORE, kinds, looks)}) x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
every AS (SELECT *, CASE WHEN k = 0 THEN regexp_extract(m, '{quoted(S.ASSIGN)}', 2) ELSE m END AS v FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
held AS (SELECT v, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT coalesce(owner, chr(0)) || chr(1) || repo) AS repos FROM every GROUP BY v),
judged AS (SELECT every.*, (owners <= {max_owners} AND repos <= {max_repositories}) AS live FROM every JOIN held USING (v)),
b AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, string_agg({shown}) AS shown FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg({shown}) AS shown FROM (SELECT doc_id, k, s, e FROM base UNION ALL SELECT doc_id, k, s, e FROM judged WHERE live AND k > 2) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_examples FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b.shown, '')) AS base_sha256, coalesce(a.shown, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_examples, 0)::BIGINT AS n_examples
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN j USING (doc_id)
"""
