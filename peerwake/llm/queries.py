"""The operators as named queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bpe, chat, collocations, decontaminate, exact_dedup, langid, licenses, range_coder, rules, simhash, spelling, surrogates,
               toxicity)
from .common import LOWER, UPPER, table


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark, sf_dir):
    return rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_files(spark, sf_dir):
    return range_coder.digests(table(spark, sf_dir, "documents"))


def op5_perspectives(spark, sf_dir):
    """The mask as text: start-end, comma-joined."""
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op6_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_surrogates(spark, sf_dir):
    return surrogates.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates_of(spark))


def op9_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op10_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.memberships(table(spark, sf_dir, "documents"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_simhash, op4_token_files, op5_perspectives, op6_byte_bpe, op7_surrogates,
                                    op8_license_scan, op9_decontamination, op10_language_id, op11_exact_dedup, op12_collocations,
                                    op13_spelling_variants)}


def _rules_sql() -> str:
    cells = ", ".join(f"('{r}', {c})" for r in rules.RULES for c in rules.GRID)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in rules.RULES) + " END"
    risk, families = rules.RISK / len(rules.RULES), f"{len(rules.RULES)} * (SELECT count(DISTINCT coalesce(lang, '')) FROM good)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, p, list_slice(ws, p, p + 7) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
hit AS (SELECT rid, count(DISTINCT p + k) AS n FROM win JOIN twice USING (rid, g), range(0, 8) r(k) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(hit.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
             length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts FROM w LEFT JOIN hit USING (rid)),
f AS (SELECT *, coalesce(n_symbols / nullif(word_chars, 0)::DOUBLE, 0) AS symbols, coalesce(n_capitals / nullif(word_chars, 0)::DOUBLE, 0) AS capitals,
             coalesce(n_shouts / nullif(n_words, 0)::DOUBLE, 0) AS shouts, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_lines,
             coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0) AS repeats, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
good AS (SELECT f.* FROM f WHERE doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
cell(rule, cutoff) AS (VALUES {cells}),
k AS (SELECT lang, rule, cutoff::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff::DOUBLE) AS k FROM good, cell GROUP BY ALL),
t AS (SELECT *, CASE WHEN k < n * {risk} THEN list_sum(list_transform(range(0, k + 1), lambda j:
        exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) ELSE 1 END AS p FROM k),
stop AS (SELECT lang, rule, max(cutoff) FILTER (p > {rules.DELTA} / ({families})) AS stop FROM t GROUP BY ALL),
cut AS (SELECT t.lang, t.rule, min(cutoff) AS cutoff FROM t JOIN stop ON t.lang IS NOT DISTINCT FROM stop.lang AND t.rule = stop.rule
        WHERE stop IS NULL OR cutoff > stop GROUP BY ALL),
bad AS (SELECT rid, string_agg(rule, ',' ORDER BY o) AS rejected_by FROM f JOIN cut ON f.lang IS NOT DISTINCT FROM cut.lang
        JOIN (SELECT rule, min(o) AS o FROM (SELECT rule, row_number() OVER () AS o FROM cell) GROUP BY rule) USING (rule) WHERE {value} > cutoff GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM f LEFT JOIN bad USING (rid)"""


CHAT_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
             ORDER BY turn NULLS FIRST, coalesce(nullif(role, ''), 'unknown'), coalesce(text, '')) - 1 AS rank FROM conversations),
s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
r AS (SELECT t.conv_id, perspective, rank // {chat.PART} AS part, rank, speaker = perspective AS own,
             CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user:' || speaker || '|>' || chr(10) END AS head,
             text || '<|end|>' || chr(10) AS body FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY rank) AS stop FROM r)
SELECT conv_id, perspective, part::BIGINT AS part, count(*)::INT AS n_turns, string_agg(head || body, '' ORDER BY rank) AS text,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY rank) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, perspective, part"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(ws, p, p + 9) AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM iw),
dw AS (SELECT rid, p, n, list_slice(ws, p, p + n - 1) AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT rid, p, n, item_id FROM dw JOIN iw USING (g)),
hit AS (SELECT rid, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT rid, p, n FROM h), range(0, 10) r(k) WHERE k < n GROUP BY rid),
item AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN item USING (rid)"""

EXACT_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS g FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY g) AS group_size, row_number() OVER w = 1 AS kept, sha256(g) AS text_sha256
FROM d WINDOW w AS (PARTITION BY g ORDER BY length(text) DESC, doc_id NULLS LAST)"""

COLLOCATIONS_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, list_slice(ws, i, i + k - 1) AS g, count(*) AS f
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 4) r(k) WHERE len(ws) >= k) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 10),
gone AS (SELECT DISTINCT s.lang, s.g FROM (SELECT lang, f, unnest([g[1:2], g[2:3]]) AS s FROM c WHERE k = 3) l JOIN c s ON s.lang = l.lang AND s.g = l.s WHERE 100 * l.f >= 50 * s.f),
cut AS (SELECT c.lang, c.g, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
        FROM c, range(1, 3) q(j), g x, g y WHERE j < c.k AND x.lang = c.lang AND y.lang = c.lang AND x.g = c.g[1:j] AND y.g = c.g[j + 1:c.k]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS o FROM cut),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = best.lang AND gone.g = best.g)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN t USING (lang) WHERE rank <= 2000"""


def oracles() -> dict[str, str]:
    return {"op2_quality_rules": _rules_sql(), "op5_perspectives": CHAT_SQL, "op9_decontamination": DECONTAMINATION_SQL,
            "op11_exact_dedup": EXACT_DEDUP_SQL, "op12_collocations": COLLOCATIONS_SQL}
