"""The contract queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import audio, bpe, langid, neardup, overlap, packing, pii, prefix, resample, tokenstore, topk, toxicity, warc
from quire.llm.common import fresh_dir, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 100 = 0"), k=10, id_col="vec_id", vector_col="embedding", scale=1024)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "token-store")
    tokenstore.write(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=0)
    return tokenstore.read_digests(spark, path)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).select("doc_id", "held_out", "score", "predicted", "distance")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder, least=1000)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.detect(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.extract(audio.store(table(spark, sf_dir, "documents"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarise(pii.find(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", budget=2048, end_id=0)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least=20, seed=7)


def op13_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.sales_in_sessions(*(table(spark, sf_dir, x) for x in ("sales", "sale_lines", "clicks")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_token_store": op2_token_store,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_langid": op5_langid,
    "op6_minhash": op6_minhash,
    "op7_bpe": op7_bpe,
    "op8_media": op8_media,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_token_counts": op11_token_counts,
    "op12_resample": op12_resample,
    "op13_overlap": op13_overlap,
}

#: DuckDB has no CRC-32: the table of bytes, and the checksum of a text by it, for WITH crc AS (SELECT ... AS t).
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc(text: str) -> str:
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || hex(encode({text}))[2 * i - 1 : 2 * i])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE: dict[str, str] = {
    "op9_pii": pii.sql(),
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op4_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN top > page_id THEN top END AS refers_to FROM r""",
    "op6_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        g AS (
            SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (
            SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
            WHERE 100 * c >= 85 * (x.n + y.n - c)),
        u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.c = u.a)
        SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
        FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op13_overlap": f"""
        WITH crc AS (SELECT {CRC_TABLE} AS t),
        c AS (
            SELECT client_id, ts, kind, lag(ts) OVER (PARTITION BY client_id ORDER BY ts) AS earlier FROM clicks
            WHERE client_id IS NOT NULL AND ts IS NOT NULL),
        n AS (
            SELECT *, sum(CASE WHEN ts - earlier > INTERVAL 15 MINUTE THEN 1 ELSE 0 END)
                OVER (PARTITION BY client_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM c),
        k AS (
            SELECT client_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, bool_or(ts = top AND kind = 'error') AS open
            FROM (SELECT *, max(ts) OVER (PARTITION BY client_id, session) AS top FROM n) GROUP BY client_id, session),
        b AS (
            SELECT client_id, first_us // 21600000000 AS s, CASE WHEN coalesce(open, false) THEN 1e12::BIGINT ELSE last_us // 21600000000 END AS e,
                {crc("first_us::VARCHAR")} AS x FROM k, crc),
        l AS (SELECT sale_id, max(shipped_at) AS shipped FROM sale_lines GROUP BY 1),
        a AS (
            SELECT sale_id, client_id, epoch_us(sold_at) // 21600000000 AS s,
                CASE WHEN status = 'open' THEN 1e12::BIGINT ELSE epoch_us(greatest(sold_at, shipped)) // 21600000000 END AS e
            FROM sales LEFT JOIN l USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
        p AS (
            SELECT sale_id,
                CASE WHEN a.s < b.s THEN CASE WHEN a.e < b.e THEN 'overlaps' WHEN a.e = b.e THEN 'finished_by' ELSE 'contains' END
                    WHEN a.s = b.s THEN CASE WHEN a.e < b.e THEN 'starts' WHEN a.e = b.e THEN 'equals' ELSE 'started_by' END
                    ELSE CASE WHEN a.e < b.e THEN 'during' WHEN a.e = b.e THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
                CASE WHEN a.e < 1e12 OR b.e < 1e12 THEN least(a.e, b.e) - greatest(a.s, b.s) + 1 END AS shared, x
            FROM a JOIN b ON a.client_id = b.client_id AND a.s <= b.e AND b.s <= a.e)
        SELECT sale_id, relation, count(*) AS n_pairs, CAST(sum(shared) AS BIGINT) AS overlap_slots, CAST(sum(x) AS BIGINT) AS sessions_crc
        FROM p GROUP BY 1, 2""",
    "op12_resample": rf"""
        WITH crc AS (SELECT {CRC_TABLE} AS t),
        x AS (
            SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark),
        w AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM x),
        f AS (SELECT row, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
        h AS (SELECT f, {crc("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM f), crc),
        n AS (
            SELECT b, count(*) FILTER (WHERE doc_id IS NOT NULL) AS s, count(*) FILTER (WHERE doc_id IS NULL) AS t
            FROM f JOIN h USING (f) GROUP BY b),
        g AS (
            SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain
            FROM n),
        v AS (SELECT row, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN h USING (f) JOIN g USING (b) GROUP BY row),
        r AS (
            SELECT doc_id, len(w) >= 20 AS may, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('7:' || doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM w LEFT JOIN v USING (row) WHERE doc_id IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE may) OVER () AS n FROM r)
        SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 25 * n // 100 THEN place END AS rank FROM k""",
}
