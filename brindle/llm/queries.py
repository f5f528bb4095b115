"""The registered queries of the training-data operators, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every whole text of documents."""
    import public_tokenizers

    from brindle.llm import bpe

    return bpe.encode_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_langid")
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learnt from two thirds of them."""
    from brindle.llm import langid

    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return langid.identify(docs, held_out).withColumn("held_out", held_out)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of documents, learnt from four fifths of the labels."""
    from brindle.llm import quality

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return quality.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), held_out=held_out).withColumn("held_out", held_out)


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    "op7_near_duplicates",
    rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    sized AS (SELECT s.doc_id, s.s, n.n FROM s JOIN n USING (doc_id)),
    e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
    SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id, min(r.y) = r.x AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x""",
)
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are 80 per cent alike."""
    from brindle.llm import neardup

    return neardup.near_duplicates(load(spark, sf_dir, "documents"), k=2, percent=80)


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(
    "op2_decontamination",
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    ds AS (SELECT doc_id, len(w) AS size, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM d)),
    bs AS (SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, len(w) AS n, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM (SELECT *, unnest(range(len(w) - 4)) AS p FROM b)) GROUP BY item_id, n, s),
    hits AS (SELECT DISTINCT doc_id, item_id, n, greatest(0, least(p, size - n)) AS start FROM ds JOIN bs USING (s)),
    v AS (SELECT h.doc_id, h.item_id, h.start, ds.s, count(*) AS c FROM hits h JOIN ds ON ds.doc_id = h.doc_id AND ds.p BETWEEN h.start AND h.start + h.n - 5 GROUP BY ALL),
    m AS (SELECT v.doc_id, v.item_id, v.start, sum(least(v.c, coalesce(bs.c, 0))) AS both_, sum(v.c) AS a FROM v LEFT JOIN bs ON bs.item_id = v.item_id AND bs.s = v.s GROUP BY ALL),
    t AS (SELECT item_id, sum(c) AS t FROM bs GROUP BY item_id),
    r AS (SELECT doc_id, item_id, start, CAST(both_ AS DOUBLE) / CAST(a + t - both_ AS DOUBLE) AS similarity FROM m JOIN t USING (item_id) WHERE 100 * both_ >= 80 * (a + t - both_))
    SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start_word FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1""",
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, with the item and the best window."""
    from brindle.llm import decontam

    return decontam.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


#: Stands for a secret that a deployment would read from its own store.
DEMO_KEY = b"not a secret: for queries on synthetic tables only"


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents with personal data replaced by format-preserving pseudonyms."""
    from brindle.llm import pii

    return pii.pseudonymised(load(spark, sf_dir, "documents"), DEMO_KEY)


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(d, i * 5 + 1, 5) AS INTEGER) >> {k}) % 32 + 1, 1)" for k in (15, 10, 5, 0))


@query(
    "op4_warc",
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages), f AS (SELECT d, min(page_id) AS f FROM p GROUP BY d)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda i: {_B32}), '') AS payload_digest,
    CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM p JOIN f USING (d)""",
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written to WARC archives with revisits, and read back by byte ranges."""
    from brindle.llm import warc

    return warc.round_trip(load(spark, sf_dir, "pages"), min_bytes=0)


@query(
    "op9_repeats",
    """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
    z AS (SELECT doc_id, n, c, substr(h, CAST(2 * c + 1 AS BIGINT), 1398) AS h FROM (SELECT doc_id, n, h, unnest(range(0, n - 199, 500)) AS c FROM t WHERE n >= 200)),
    p AS (SELECT doc_id, c + q AS p, md5_number(substr(h, CAST(2 * q + 1 AS BIGINT), 400)) AS s FROM (SELECT doc_id, c, h, unnest(range(least(500, n - 199 - c))) AS q FROM z)),
    r AS (SELECT doc_id, p FROM p JOIN (SELECT s FROM p GROUP BY s HAVING count(*) > 1) USING (s)),
    g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 200 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
    i AS (SELECT doc_id, k, min(p) AS a, max(p) + 200 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
    c AS (SELECT doc_id, b AS x, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM i UNION ALL SELECT doc_id, 0, min(a) FROM i GROUP BY doc_id),
    kept AS (SELECT c.doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (coalesce(y, n) - x) AS BIGINT)), '' ORDER BY x) AS k FROM c JOIN t USING (doc_id) GROUP BY c.doc_id),
    s AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM i GROUP BY doc_id)
    SELECT t.doc_id, t.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, CASE WHEN s.doc_id IS NULL THEN h ELSE '' END))) AS kept_sha256 FROM t LEFT JOIN s USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents without the bytes of 200-byte strings that occur more than once."""
    from brindle.llm import repeats

    return repeats.without_repeats(load(spark, sf_dir, "documents"))


@query("op5_compaction", "SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha256, source FROM documents")
def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents appended as small shards, compacted, and read back through the newest manifest."""
    from brindle.llm import compaction, shared

    store = compaction.ShardStore(spark, shared.fresh(spark, "shards"))
    store.append(load(spark, sf_dir, "documents"))
    store.compact()
    return store.read().select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "source")


@query("op3_nearest")
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of embeddings of every row whose vec_id is divisible by 20."""
    from brindle.llm import ann

    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
