"""The queries of the text operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillvault.llm import ctph, exact, langid, minhash, mixing, packing, passages, phrases, repair, repetition, suffixes, toxicity, warc
from tillvault.llm.common import documents, tune

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir)).drop("spans")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("text_md5")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.with_edits(documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(tune(spark).read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN strlen(payload) >= 100 AND page_id > least_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(payload) >= 100 AND page_id > least_id THEN least_id END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS payload,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least_id FROM pages)
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).drop("row")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(documents(spark, sf_dir)).drop("kept_text", "spans")


_WORD = "[^ \\t\\n\\x0B\\f\\r]+"
_NO_WORD = "[ \\t\\n\\x0B\\f\\r]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _islands(name: str, rows: str) -> str:
    """Overlapping and touching spans of a document as one."""
    return f"""
{name} AS (SELECT doc_id, min(a) AS a, max(b) AS b
           FROM (SELECT *, count_if(opens) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island
                 FROM (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens
                       FROM (SELECT doc_id, start AS a, start + size AS b FROM later WHERE {rows})))
           GROUP BY doc_id, island)"""


OP10_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, trim(regexp_replace({_LOW.format("line")}, '{_NO_WORD}', ' ', 'g'), ' ') AS unit,
                 sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start,
                 length(line) + (i < n)::INT AS size
          FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n
                FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM texts))),
words AS (SELECT doc_id, i, n, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS w,
                 sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS e
          FROM (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i, len(ts) AS n
                FROM (SELECT doc_id, regexp_extract_all(text, '{_NO_WORD.replace("+", "*")}{_WORD}') AS ts FROM texts))),
sentences AS (SELECT doc_id, k, string_agg({_LOW.format("w")}, ' ' ORDER BY i) AS said, sum(length(w)) AS c, min(e - length(w)) AS a
              FROM (SELECT *, coalesce(count_if(w[-1] IN ('.', '!', '?')) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
                    FROM words) GROUP BY doc_id, k),
summed AS (SELECT sentences.*, row_number() OVER w AS j, sum(c) OVER w AS upto, coalesce(lead(a) OVER w, length(text)) AS b
           FROM sentences JOIN texts USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
whole AS (SELECT doc_id, list(said ORDER BY j) AS ss FROM summed GROUP BY doc_id),
paragraphs AS (SELECT f.doc_id, array_to_string(ss[f.j:l.j], ' ') AS unit, f.a AS start, l.b - f.a AS size
               FROM (SELECT *, upto - c + {passages.LEAST} AS needs FROM summed) f
               ASOF JOIN summed l ON f.doc_id = l.doc_id AND f.needs <= l.upto JOIN whole ON whole.doc_id = f.doc_id),
units AS (SELECT doc_id, {passages.LINE} AS kind, unit, start, size FROM lines WHERE unit <> ''
          UNION ALL SELECT doc_id, {passages.PARAGRAPH}, unit, start, size FROM paragraphs),
later AS (FROM units QUALIFY row_number() OVER (PARTITION BY kind, unit ORDER BY doc_id, start) > 1),
{_islands("gone", "true")},{_islands("said_again", f"kind = {passages.PARAGRAPH}")},
pieces AS (SELECT doc_id, a, text[coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0)::BIGINT + 1:a::BIGINT] AS piece FROM gone JOIN texts USING (doc_id)),
kept AS (SELECT doc_id, coalesce(head, '') || text[coalesce(upto, 0)::BIGINT + 1:] AS rest, coalesce(n, 0) AS n FROM texts
         LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS head FROM pieces GROUP BY doc_id) USING (doc_id)
         LEFT JOIN (SELECT doc_id, max(b) AS upto, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id))
SELECT doc_id, n AS n_removed, coalesce(n_lines, 0) AS n_lines, coalesce(n_passages, 0) AS n_passages,
       length(text) AS n_chars, length(rest) AS kept_chars, sha256(rest) AS kept_sha256
FROM kept JOIN texts USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM later WHERE kind = {passages.LINE} GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_passages FROM said_again GROUP BY doc_id) USING (doc_id)
"""


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(tune(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


def _covered(n: int) -> str:
    """Words of each text in n-grams found twice or more, and characters of those in n-grams found earlier."""
    return f"""
g{n} AS (SELECT doc_id, i, w, CASE WHEN i + {n - 1} <= len(ws) THEN array_to_string(ws[i:i+{n - 1}], ' ') END AS gram FROM placed),
t{n} AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again,
              gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS later FROM g{n}),
c{n} AS (SELECT doc_id, count_if(r) AS words, coalesce(sum(length(w)) FILTER (l), 0) AS chars
       FROM (SELECT doc_id, w, bool_or(again) OVER s AS r, bool_or(later) OVER s AS l FROM t{n}
             WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) GROUP BY doc_id)"""


_LENGTHS = sorted({*repetition.LIMITS, repetition.BASE_LENGTH})
_FAILED = f"len(ws) < {repetition.LEAST_WORDS} OR 100 * coalesce(c{repetition.BASE_LENGTH}.words, 0) > {repetition.BASE_LIMIT} * len(ws)"
_WITHIN = "".join(f" AND 100 * coalesce(c{n}.chars, 0) <= {limit} * all_chars" for n, limit in repetition.LIMITS.items())
OP12_SQL = f"""
WITH texts AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws, length(regexp_replace(text, '{_NO_WORD}', '', 'g')) AS all_chars
               FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
placed AS (SELECT doc_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
lines AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '{_NO_WORD}', '', 'g'))) AS chars
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
                FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
                      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM texts))
                WHERE regexp_matches(line, '{_WORD}')) WHERE nth > 1 GROUP BY doc_id),
{",".join(map(_covered, _LENGTHS))}
SELECT texts.doc_id, len(ws) AS n_words, all_chars AS word_chars,
       length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
       coalesce(c{repetition.BASE_LENGTH}.words, 0) AS n_repeat_words, {_FAILED} AS base_failed,
       NOT ({_FAILED}) AND 100 * coalesce(lines.chars, 0) <= {repetition.LINE_LIMIT} * all_chars{_WITHIN} AS kept,
       coalesce(lines.chars, 0)::BIGINT AS dup_line_chars,
       {", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in repetition.LIMITS)}
FROM texts LEFT JOIN lines USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in _LENGTHS)}
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir)).drop("size")


OP13_SQL = f"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws
                FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
found AS (SELECT lang, size, phrase, count(*) AS f
          FROM (SELECT lang, size, array_to_string(ws[i:i+size-1], ' ') AS phrase
                FROM (SELECT *, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM pieces, range(1, {phrases.LONGEST + 1}) r(size)))
          GROUP BY ALL HAVING f >= {phrases.LEAST_COUNT}),
candidates AS (FROM found c WHERE size > 1 AND NOT EXISTS (
    FROM found o WHERE o.lang = c.lang AND o.size > c.size AND 100 * o.f::HUGEINT >= {phrases.PART_OF} * c.f::HUGEINT
                   AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first,
                array_to_string(string_split(phrase, ' ')[k+1:], ' ') AS rest
         FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM candidates)),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, (2000000 * a::HUGEINT // (l.f + r.f))::BIGINT AS score
           FROM cuts JOIN found l ON l.lang = cuts.lang AND l.phrase = first JOIN found r ON r.lang = cuts.lang AND r.phrase = rest),
least AS (FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least JOIN totals USING (lang) QUALIFY rank <= {phrases.TOP}
"""


def queries() -> dict[str, Query]:
    return {"op1_packing": op1_packing, "op2_exact": op2_exact, "op3_suffixes": op3_suffixes, "op4_minhash": op4_minhash, "op5_toxicity": op5_toxicity, "op6_langid": op6_langid, "op7_warc": op7_warc, "op8_mixing": op8_mixing, "op9_ctph": op9_ctph, "op10_passages": op10_passages, "op11_repair": op11_repair, "op12_repetition": op12_repetition, "op13_phrases": op13_phrases}


def oracles() -> dict[str, str]:
    return {"op2_exact": OP2_SQL, "op7_warc": OP7_SQL, "op10_passages": OP10_SQL, "op12_repetition": OP12_SQL, "op13_phrases": OP13_SQL}
