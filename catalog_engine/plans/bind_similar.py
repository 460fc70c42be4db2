"""Duplicates and similarity on documents and embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog_engine.functions.arrays import let
from catalog_engine.functions.normalise import cosine
from catalog_engine.operators import ranking, similar as op
from catalog_engine.plans.bind_ranking import PROFILE_SQL, profiles
from catalog_engine.plans.binding import bind
from catalog_engine.workspace import staged


@bind("content_hash", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", op.content_hash("text").alias("digest"))


@bind(
    "exact_duplicates",
    """WITH r AS (SELECT lang, doc_id, md5(text) AS h, n_chars + doc_id % 3 AS size, CASE WHEN doc_id % 3 = 1 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS rank FROM documents),
            w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY lang, h ORDER BY rank, size DESC, doc_id) AS survivor FROM r)
       SELECT lang, doc_id AS deleted, survivor FROM w WHERE doc_id <> survivor""",
)
def _(t):
    kind = F.when(F.col("doc_id") % 3 == 1, 1).when(F.col("doc_id") % 3 == 0, 3).otherwise(2)
    docs = t.documents.select("lang", "doc_id", F.md5("text").alias("digest"), kind.alias("kind"), (F.col("n_chars") + F.col("doc_id") % 3).alias("size"))
    return op.exact_duplicates(docs, "lang", "digest", "kind", "size", "doc_id")


# each component as one byte, 0 to 255
BYTE_SQL = "SELECT vec_id, label, pos, greatest(least(floor((v + 1) * 128), 255), 0)::INT AS b FROM (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def byte_rows(t):
    scaled = F.transform("embedding", lambda v: F.greatest(F.least(F.floor((v.cast("double") + 1) * 128), F.lit(255)), F.lit(0)).cast("int"))
    return t.embeddings.select("vec_id", "label", scaled.alias("bytes"))


def pictures(df, height, width, cell):
    """Grey pictures from the byte rows; ``cell`` maps the pixel index to a component."""
    pixels = F.sequence(F.lit(0), F.lit(height * width - 1))
    digits = let(F.col("bytes"), lambda b: F.transform(pixels, lambda i: F.lpad(F.hex(F.get(b, cell(i).cast("int"))), 2, "0")))
    image = F.struct(
        F.concat(F.lit("file:/root/owner_"), "label", F.lit("/coin_type_"), "vec_id", F.lit("/images/p"), "vec_id", F.lit(".png")).alias("origin"),
        F.when(F.col("vec_id") % 11 == 0, -1).otherwise(height).alias("height"), F.when(F.col("vec_id") % 11 == 0, -1).otherwise(width).alias("width"),
        F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.unhex(F.array_join(digits, "")).alias("data"),
    )
    return staged(df.select("vec_id", "label", image.alias("image")), "images")


def same_cell(i):
    return i


@bind(
    "pixel_hash",
    f"""SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN md5('8x8x0x' || h) END IS NOT NULL AS readable, count(*) FILTER (WHERE vec_id % 11 <> 0) OVER (PARTITION BY CASE WHEN vec_id % 11 <> 0 THEN h END) AS equals FROM (
          SELECT vec_id, string_agg(b::VARCHAR, ',' ORDER BY pos) AS h FROM (SELECT vec_id % 250 AS src, * FROM ({BYTE_SQL})) GROUP BY vec_id)""",
)
def _(t):
    hashed = pictures(byte_rows(t), 8, 8, same_cell).select("vec_id", op.pixel_hash("image").alias("digest"))
    counts = hashed.groupBy(F.col("digest").alias("_d")).agg(F.count("digest").alias("equals"))
    joined = hashed.join(counts, F.col("digest").eqNullSafe(F.col("_d")))
    return joined.select("vec_id", F.col("digest").isNotNull().alias("readable"), "equals")


DHASH_SQL = """SELECT vec_id, label, coalesce(sum(1::BIGINT << (y * 7 + x)::INT) FILTER (WHERE v > nxt), 0)::BIGINT AS hash FROM (
    SELECT vec_id, label, pos % 8 AS x, pos // 8 AS y, v, lead(v) OVER (PARTITION BY vec_id, pos // 8 ORDER BY pos) AS nxt FROM (
      SELECT vec_id, label, pos, greatest(least(v, hi), lo) AS v FROM (SELECT *, list_sort(list(v) OVER (PARTITION BY vec_id))[4] AS lo, list_sort(list(v) OVER (PARTITION BY vec_id))[61] AS hi FROM (
        SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)))) WHERE x < 7 GROUP BY ALL"""


def hashed(t):
    return t.embeddings.select("vec_id", "label", op.dhash64("embedding", width=8).alias("hash"))


@bind("dhash64", DHASH_SQL)
def _(t):
    return hashed(t)


@bind(
    "dhash64_image",
    f"""WITH b AS ({BYTE_SQL}), c AS (SELECT vec_id, i % 9 AS x, i // 9 AS y, b FROM b JOIN (SELECT unnest(range(72)) AS i) ON i % 64 = pos),
            n AS (SELECT vec_id, x, y, b, lead(b) OVER (PARTITION BY vec_id, y ORDER BY x) AS nxt FROM c)
       SELECT vec_id, sum(CASE WHEN b > nxt THEN (1::HUGEINT << (y * 8 + x)::INT) ELSE 0 END) FILTER (WHERE x < 8 AND y < 4)::BIGINT AS low_half,
         bit_count(sum(CASE WHEN b > nxt THEN (1::HUGEINT << (y * 8 + x)::INT) ELSE 0 END) FILTER (WHERE x < 8)::HUGEINT)::INT AS bits FROM n WHERE vec_id % 11 <> 0 GROUP BY vec_id
       UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE vec_id % 11 = 0""",
)
def _(t):
    # an 18 by 16 picture whose 2 by 2 blocks are the 9 by 8 cells
    cell = lambda i: (F.floor(F.floor(i / 18) / 2) * 9 + F.floor(i % 18 / 2)) % 64
    images = pictures(byte_rows(t), 16, 18, cell)
    small = images.select("vec_id", op.resample("luma")("image").alias("cells"))
    bits = small.select("vec_id", op.dhash64("cells", stretch=False).alias("hash"))
    return bits.select("vec_id", F.col("hash").bitwiseAND((1 << 32) - 1).alias("low_half"), F.bit_count("hash").alias("bits"))


LIMIT = 15
PAIRS_SQL = f"""WITH h AS ({DHASH_SQL}), d AS (SELECT label, hash, min(vec_id) AS id FROM h GROUP BY ALL),
    pairs AS (SELECT a.label, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM d a JOIN d b ON a.label = b.label AND a.hash < b.hash
                WHERE bit_count(xor(a.hash, b.hash)) <= {LIMIT}
              UNION ALL SELECT h.label, d.id, h.vec_id, 0 FROM h JOIN d ON d.label = h.label AND d.hash = h.hash AND d.id <> h.vec_id)"""


@bind("hamming_pairs", f"{PAIRS_SQL} SELECT * FROM pairs")
def _(t):
    return op.hamming_pairs(staged(hashed(t), "hashed"), "label", "hash", "vec_id", LIMIT)


@bind(
    "leader_groups",
    f"""WITH RECURSIVE h AS ({DHASH_SQL}), d AS (SELECT label, hash, min(vec_id) AS id FROM h GROUP BY ALL),
          o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS pos FROM d),
          r AS (SELECT label, pos, [hash] AS led FROM o WHERE pos = 1
                UNION ALL SELECT o.label, o.pos, CASE WHEN len(list_filter(r.led, lambda x: bit_count(xor(x, o.hash)) <= {LIMIT})) > 0 THEN r.led ELSE list_append(r.led, o.hash) END
                FROM r JOIN o ON o.label = r.label AND o.pos = r.pos + 1),
          f AS (SELECT label, arg_max(led, pos) AS led FROM r GROUP BY label),
          g AS (SELECT h.vec_id, h.label, list_filter(f.led, lambda x: bit_count(xor(x, h.hash)) <= {LIMIT})[1] AS leader FROM h JOIN f ON f.label = h.label),
          s AS (SELECT g.label, g.leader, d.id, count(*) AS n FROM g JOIN d ON d.label = g.label AND d.hash = g.leader GROUP BY ALL),
          k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS group_id FROM s WHERE n > 1)
        SELECT g.vec_id, g.label, k.group_id FROM g LEFT JOIN k ON k.label = g.label AND k.leader = g.leader""",
)
def _(t):
    return op.leader_groups(staged(hashed(t), "hashed"), "label", "hash", "vec_id", LIMIT).select("vec_id", "label", "group_id")


@bind(
    "similar_components",
    """WITH RECURSIVE """ + PAIRS_SQL.removeprefix("WITH ") + """, e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
         r AS (SELECT a AS id, a AS reached FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached)
       SELECT id, min(reached) AS component FROM r GROUP BY id""",
)
def _(t):
    return op.similar_components(op.hamming_pairs(staged(hashed(t), "hashed"), "label", "hash", "vec_id", LIMIT))


COSINE_SQL = "list_dot_product(x, y) / ((sqrt(list_dot_product(x, x)) + 1e-8) * (sqrt(list_dot_product(y, y)) + 1e-8))"


@bind(
    "cosine",
    f"""SELECT vec_id, round({COSINE_SQL}, 6) AS similarity FROM (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
)
def _(t):
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(following, "vec_id").select("vec_id", F.round(cosine("embedding", "other"), 6).alias("similarity"))


def _cos(x: str, y: str) -> str:
    dot = lambda p, q: f"list_dot_product({p}, {q})"
    return f"{dot(x, y)} / ((sqrt({dot(x, x)}) + 1e-8) * (sqrt({dot(y, y)}) + 1e-8))"


@bind(
    "detect_swaps",
    f"""WITH s AS (SELECT a.vec_id // 2 AS sample, a.label, a.embedding::DOUBLE[] AS f, b.embedding::DOUBLE[] AS k FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
            r AS (SELECT label, min(sample) AS rid FROM s WHERE sample % 5 = 0 GROUP BY label),
            p AS (SELECT s.sample, s.label, r.rid, {_cos('s.f', 'q.f')} + {_cos('s.k', 'q.k')} AS m, {_cos('s.f', 'q.k')} + {_cos('s.k', 'q.f')} AS x
                  FROM s JOIN r ON r.label = s.label JOIN s q ON q.sample = r.rid WHERE s.sample % 5 <> 0)
       SELECT sample, label, rid AS reference_id, round(m, 6) AS match_score, round(x, 6) AS flip_score, x > m AS swapped FROM p""",
)
def _(t):
    even = t.embeddings.filter("vec_id % 2 = 0").select("vec_id", "label", F.col("embedding").alias("front"))
    odd = t.embeddings.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("back"))
    samples = even.join(odd, "vec_id").withColumn("sample", F.expr("vec_id div 2"))
    scored = op.detect_swaps(samples, "label", F.col("sample") % 5 == 0, "sample", "front", "back")
    return scored.withColumn("match_score", F.round("match_score", 6)).withColumn("flip_score", F.round("flip_score", 6))


@bind(
    "detect_holders",
    """SELECT p_partkey, CASE WHEN w / h >= 0.5 AND w / h < 0.85 THEN 1 ELSE 0 END AS is_holder FROM (SELECT p_partkey, p_size::DOUBLE AS w, (20 + p_partkey % 40)::DOUBLE AS h, p_partkey % 2 AS stored FROM part)
       WHERE CASE WHEN w / h >= 0.5 AND w / h < 0.85 THEN 1 ELSE 0 END <> stored""",
)
def _(t):
    sizes = t.part.select("p_partkey", "p_size", (20 + F.col("p_partkey") % 40).alias("h"), (F.col("p_partkey") % 2).cast("int").alias("is_holder"))
    return op.detect_holders(sizes, "p_partkey", "p_size", "h", "is_holder")


@bind(
    "broken_images",
    "SELECT 'owner_' || label AS owner, 'coin_type' AS slug, vec_id AS entity_id, 'p' || vec_id || '.png' AS file FROM embeddings WHERE vec_id % 11 = 0",
)
def _(t):
    return op.broken_images(pictures(byte_rows(t), 8, 8, same_cell))


@bind("resolution", "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 64 END::BIGINT AS pixels FROM embeddings")
def _(t):
    images = pictures(byte_rows(t), 8, 8, same_cell).select("vec_id", "image.width", "image.height")
    return images.select("vec_id", op.resolution("width", "height").alias("pixels"))


@bind(
    "corner_stats",
    f"""SELECT vec_id, round(avg(s), 6) AS spread FROM (SELECT vec_id, x // 4 AS cx, y // 4 AS cy, stddev_pop(b) AS s FROM (SELECT vec_id, pos % 8 AS x, pos // 8 AS y, b FROM ({BYTE_SQL}))
          WHERE x NOT IN (3, 4) AND y NOT IN (3, 4) AND vec_id % 11 <> 0 GROUP BY ALL) GROUP BY vec_id
        UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id % 11 = 0""",
)
def _(t):
    images = pictures(byte_rows(t), 8, 8, same_cell)
    return images.select("vec_id", F.round(op.corner_stats(3)("image"), 6).alias("spread"))


@bind(
    "split_position",
    f"""WITH r AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN (10 + vec_id % 7 + 12 + 40) // 2 WHEN 1 THEN 10 + (vec_id % 7 + 20) // 2 ELSE 31 END AS rough FROM embeddings),
            p AS (SELECT r.vec_id, rough, pos, e, max(e) OVER (PARTITION BY r.vec_id) AS top, avg(e) OVER (PARTITION BY r.vec_id) AS mean FROM ({PROFILE_SQL}) q JOIN r ON r.vec_id = q.vec_id WHERE pos >= rough - 3 AND pos < rough + 3)
       SELECT vec_id, coalesce(min(pos) FILTER (WHERE e = top AND top > 2 * mean), any_value(rough))::BIGINT AS split FROM p GROUP BY vec_id""",
)
def _(t):
    box = lambda x, w: F.struct(x.cast("int").alias("x"), w.cast("int").alias("width"))
    odd = F.col("vec_id") % 7
    boxes = F.when(F.col("vec_id") % 3 == 0, F.array(box(F.lit(10), odd + 12), box(F.lit(40), F.lit(9)))).when(F.col("vec_id") % 3 == 1, F.array(box(F.lit(10), odd + 20))).otherwise(F.array().cast("array<struct<x:int,width:int>>"))
    rows = profiles(t).withColumn("boxes", boxes)
    peak = lambda start, stop: ranking.peak_in_window("profile", start, stop, 2.0)
    return rows.select("vec_id", op.split_position(F.size("profile"), "boxes", peak).cast("bigint").alias("split"))


@bind(
    "score_batches",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * i)), 6) AS score, NULL::VARCHAR AS error FROM embeddings",
)
def _(t):
    def load():
        import numpy as np

        weights = np.arange(1, 65, dtype=np.float64)

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            vectors = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            return pd.DataFrame({"vec_id": batch["vec_id"], "score": vectors @ weights})

        return score

    scored = op.score_batches(t.embeddings.select("vec_id", "embedding"), load, "vec_id long, score double")
    return scored.withColumn("score", F.round("score", 6))
