"""Queries of the operators in this folder, with their SQL checks where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, line_dedup, mixing, neighbours, periodic_runs, pieces, quality, simhash, suffix_dedup, token_counts, tool_calls, tool_messages, vector_codes, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return register


@query(
    "op1_embedding_near_duplicates",
    """
    WITH RECURSIVE vectors AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
    ), reach AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings
        UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    ), parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN parts ON vec_id = parts.a LEFT JOIN counts ON vec_id = counts.a
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_nearest_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op3_tool_call_linking", tool_messages.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    every = tool_calls.every_occurrence(tool_messages.calls(turns), tool_messages.results(turns), tool_messages.SCHEMAS)
    return every.drop("occurrence")


@query("op4_source_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


@query("op5_simhash_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.span_digest(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op9_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS position
        FROM documents
    ), keyed AS (
        SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), repeated AS (
        SELECT key, max(doc_id) AS survivor FROM keyed WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), marked AS (
        SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.survivor AS gone
        FROM keyed k LEFT JOIN repeated r ON k.key = r.key
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


@query("op10_sentencepiece_sampling")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op11_periodic_runs",
    r"""
    WITH split AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
               -- CRC-32 of the decimal id, a byte and its eight bits at a time
               xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                   lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                   4294967295::BIGINT), 4294967295::BIGINT) AS h
        FROM documents
    ), planned AS (SELECT *, len(words) AS n, h // 10 AS g FROM split),
    placed AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM planned),
    words AS (
        SELECT doc_id, n, i, words[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM placed
    ), grams AS (
        SELECT doc_id, n, i, lag(w) OVER d AS before,
               hash(w, lead(w) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d, lead(w, 5) OVER d) AS gram
        FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), pairs AS (
        SELECT x.doc_id, x.n, x.i AS start, y.i - x.i AS period FROM grams x JOIN grams y
        ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i AND x.before IS DISTINCT FROM y.before
        WHERE y.i - x.i <= x.n - y.i AND x.n - x.i >= 12
    ), periods AS (SELECT DISTINCT doc_id, period FROM pairs),
    breaks AS (
        SELECT a.doc_id, q.period, a.i FROM periods q JOIN words a ON a.doc_id = q.doc_id
        JOIN words b ON b.doc_id = a.doc_id AND b.i = a.i + q.period WHERE a.w <> b.w
    ), measured AS (
        SELECT p.doc_id, p.start, p.period, coalesce(b.i, p.n - p.period) - p.start AS common
        FROM pairs p ASOF LEFT JOIN breaks b ON p.doc_id = b.doc_id AND p.period = b.period AND b.i >= p.start
    ), runs AS (
        SELECT doc_id, start, common + period AS length, min(period) AS period FROM measured
        WHERE common >= period AND common + period >= 12 GROUP BY doc_id, start, common + period
    ), gone AS (
        SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r
        ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length
    ), texts AS (
        SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
    ), listed AS (
        SELECT doc_id, count(*) AS n_runs, list({'l': -length, 's': start, 'p': period} ORDER BY -length, start, period)[1] AS best,
               string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS rows
        FROM runs GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period,
           1000 * -best.l // best.p AS exponent_milli, sha256(coalesce(rows, '')) AS runs_sha256, sha256(coalesce(t.text, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN texts t ON d.doc_id = t.doc_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"))


@query(
    "op12_warc",
    """
    WITH sized AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload FROM pages
    ), kept AS (
        SELECT payload, max(page_id) AS keeper FROM sized WHERE payload_bytes >= 1000 GROUP BY payload
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN keeper <> page_id THEN keeper END AS refers_to
    FROM sized LEFT JOIN kept ON sized.payload_bytes >= 1000 AND sized.payload = kept.payload
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def _code_oracle() -> str:
    """The rounds written out one after the other; a quotient is rounded down by taking off its (positive) remainder."""
    near = """
        SELECT p.vec_id, p.part, p.x, min({{'d': list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': c.entry}}) AS best
        FROM parts p JOIN book{i} c ON p.part = c.part GROUP BY p.vec_id, p.part, p.x"""
    one_round = """
    near{i} AS MATERIALIZED (%s
    ), sums{i} AS (
        SELECT part, entry, position, sum(x)::BIGINT AS total, count(*) AS n FROM (
            SELECT part, best.e AS entry, generate_subscripts(x, 1) AS position, unnest(x) AS x FROM near{i}
        ) GROUP BY part, entry, position
    ), means{i} AS (
        SELECT part, entry, list((total - ((total %% n) + n) %% n) // n ORDER BY position) AS c FROM sums{i} GROUP BY part, entry
    ), book{j} AS MATERIALIZED (
        SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN means{i} m ON b.part = m.part AND b.entry = m.entry
    ),""" % near
    rounds = "".join(one_round.format(i=i, j=i + 1) for i in range(vector_codes.ROUNDS))
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), cut AS (SELECT vec_id, v, len(v) // 8 AS w, unnest(range(8)) AS part FROM kept),
    parts AS MATERIALIZED (SELECT vec_id, part, v[part * w + 1 : (part + 1) * w] AS x FROM cut),
    book0 AS MATERIALIZED (
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts
        WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)
    ),{rounds}
    final AS ({near.format(i=vector_codes.ROUNDS)}),
    codes AS (
        SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM final GROUP BY vec_id
    ), labelled AS (SELECT c.vec_id, code, error, label FROM codes c JOIN kept k ON c.vec_id = k.vec_id),
    totals AS (SELECT label, sum(error)::BIGINT AS label_error FROM labelled GROUP BY label)
    SELECT vec_id, code, error, label_error,
           (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{vector_codes.ROUNDS}) AS codebooks_sha256
    FROM labelled l JOIN totals t ON l.label IS NOT DISTINCT FROM t.label
    """


@query("op13_vector_codes", _code_oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digest(table(spark, sf_dir, "embeddings"))
