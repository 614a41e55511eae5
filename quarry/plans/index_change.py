"""An index that follows its catalogue.

``diff`` compares the texts of a saved index with the present ones by content
hash.  ``patch`` writes only what differs, as generation n of the index:

  patches/gen=n/dead/   product_id of changed and deleted texts (tombstones)
  patches/gen=n/texts/  product_id, text of added and changed texts
  patches/gen=n/counts/ product_id, counts (token, tf) of these
  patches/gen=n/df/     token, delta of its document frequency
  patches/gen=n/meta/   one row: n_docs, n_tokens; written last

A generation without finished ``meta`` does not exist: a patch that was broken
off is written over by the next one.  ``load`` joins the generations up: a row of
generation g lives unless a tombstone of a later one names its product.  The idf
comes from the base's df and the deltas, and the vectors are weighted anew from
the stored counts, without tokenising a text again, since every weight depends on
the number of documents.  So a patched index equals one that is built from the
present texts.  ``compact`` writes it out as a new base.

Product ids are unique and not null; rows with a null id are not indexed.  A null
text is an empty one.  Equal texts are no change, and a patch without changes
writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import encode as enc
from quarry.plans import index_store as STORE
from quarry.plans.search import TextIndex
from quarry.session import materialize

BROADCAST_IDS = 1 << 18  # at most so many product ids are broadcast

ADDED, CHANGED, DELETED = "added", "changed", "deleted"


def _texts(df: DataFrame) -> DataFrame:
    return (df.where(F.col("product_id").isNotNull())
            .select("product_id", F.coalesce("text", F.lit("")).alias("text")))


def _digests(df: DataFrame, name: str) -> DataFrame:
    return _texts(df).select("product_id", F.unhex(F.md5("text")).alias(name))


def _compared(was: DataFrame, now: DataFrame) -> DataFrame:
    """(product_id, change) of all products; the change of an equal one is null."""
    change = (F.when(F.col("was").isNull(), ADDED).when(F.col("now").isNull(), DELETED)
              .when(F.col("was") != F.col("now"), CHANGED))
    return was.join(now, "product_id", "full_outer").select("product_id", change.alias("change"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(product_id, change): added, changed and deleted products; equal ones have
    no row.  Only ids and hashes are shuffled, not the texts."""
    return _compared(_digests(old, "was"), _digests(new, "now")).where("change is not null")


def generations(spark: SparkSession, path: str) -> list[int]:
    """The finished generations of the index; they are numbered without gaps."""
    found = []
    while STORE._fs_exists(spark, f"{path}/patches/gen={len(found) + 1}/meta/_SUCCESS"):
        found.append(len(found) + 1)
    return found


def _among(rows: DataFrame, ids: DataFrame, others: DataFrame) -> DataFrame:
    """Of rows whose product is either in ``ids`` or in ``others``, those of ``ids``.  The
    shorter of these (written) tables is joined; where one is empty or short enough to
    be broadcast, the rows stay in place."""
    n, m = ids.count(), others.count()
    if not n or not m:
        return rows if n else rows.where(F.lit(False))
    ids, others = (F.broadcast(t) if min(n, m) <= BROADCAST_IDS else t for t in (ids, others))
    return rows.join(ids, "product_id", "left_semi") if n <= m else rows.join(others, "product_id", "left_anti")


def _part(spark: SparkSession, path: str, part: str, gen: int) -> DataFrame:
    """``texts`` or ``counts`` of a generation (0: the base)."""
    at = f"{path}/patches/gen={gen}" if gen else path
    if part == "counts" and not STORE._fs_exists(spark, f"{at}/counts/_SUCCESS"):  # a base saved with its terms
        terms = (spark.read.parquet(f"{at}/terms").groupBy("product_id")
                 .agg(F.collect_list(F.struct("token", "tf")).alias("counts")))
        return spark.read.parquet(f"{at}/texts").select("product_id").join(terms, "product_id", "left")
    return spark.read.parquet(f"{at}/{part}")


def _ends(spark: SparkSession, path: str, last: int) -> dict[int, DataFrame]:
    """For each generation before ``last``: (product_id, end), the generation up to
    ``last`` that buried the product's row, null if none did."""
    dead = [spark.read.parquet(f"{path}/patches/gen={g}/dead").withColumn("end", F.lit(g)) for g in range(1, last + 1)]
    ends = {}
    for gen in range(last):
        later = dead[gen]
        for mark in dead[gen + 1:]:
            later = later.unionByName(mark)
        ids = _part(spark, path, "texts", gen).select("product_id").where(F.col("product_id").isNotNull())
        ends[gen] = materialize(ids.join(later.groupBy("product_id").agg(F.min("end").alias("end")),
                                         "product_id", "left"), "index-ends")
    return ends


def _live(spark: SparkSession, path: str, part: str, ends: dict[int, DataFrame], made=lambda df: df) -> DataFrame:
    """What ``made`` makes of the rows of ``texts`` or ``counts`` that no later generation
    has buried; those of the last one all live, and so do rows without an id."""
    known = F.col("product_id").isNotNull()
    out = made(_part(spark, path, part, len(ends)))
    for gen, end in ends.items():
        rows, alive = made(_part(spark, path, part, gen)), end.where("end is null")
        out = (out.unionByName(_among(rows.where(known), alive, end.where("end is not null")))
               .unionByName(rows.where(~known)))
    return out


def _sizes(spark: SparkSession, path: str, gens: list[int]) -> tuple[int, int]:
    at = f"{path}/patches/gen={gens[-1]}/meta" if gens else f"{path}/meta"
    row = spark.read.parquet(at).first()
    return int(row["n_docs"]), int(row["n_tokens"])


def patch(spark: SparkSession, path: str, texts: DataFrame) -> int:
    """Bring the index under ``path`` to ``texts`` (product_id, text); the number
    of its last generation, unchanged where nothing differs."""
    gens = generations(spark, path)
    was = _live(spark, path, "texts", _ends(spark, path, len(gens)), lambda df: _digests(df, "was"))
    states = materialize(_compared(was, _digests(texts, "now")), "index-changes")
    changes = states.where("change is not null")
    if changes.isEmpty():
        return len(gens)
    gen = len(gens) + 1
    at = f"{path}/patches/gen={gen}"
    materialize(changes.where(F.col("change") != ADDED).select("product_id"), "dead", f"{at}/dead")
    come = changes.where(F.col("change") != DELETED).select("product_id")
    same = states.where("change is null").select("product_id")
    fresh = materialize(_among(_texts(texts), come, same), "texts", f"{at}/texts", packed=True)
    counts = materialize(enc.row_counts(fresh, "product_id"), "counts", f"{at}/counts", packed=True)
    # per token: documents and occurrences that come less those that go
    moves = enc.term_counts(counts, "product_id").select("token", "tf", F.lit(1).alias("sign"))
    for old, end in _ends(spark, path, gen).items():
        here = F.coalesce(F.col("end"), F.lit(0)) == gen
        gone = _among(_part(spark, path, "counts", old).where(F.col("product_id").isNotNull()),
                      end.where(here), end.where(~here))
        moves = moves.unionByName(enc.term_counts(gone, "product_id").select("token", "tf", F.lit(-1).alias("sign")))
    moves = moves.groupBy("token").agg(F.sum("sign").alias("delta"),
                                       F.sum(F.col("sign") * F.col("tf")).alias("tokens"))
    moves = materialize(moves, "df", f"{at}/df", packed=True)
    n_docs, n_tokens = _sizes(spark, path, gens)
    step = changes.agg(F.count_if(F.col("change") == ADDED).alias("up"),
                       F.count_if(F.col("change") == DELETED).alias("down")).first()
    more = moves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    (spark.createDataFrame([(n_docs + step["up"] - step["down"], n_tokens + int(more))],
                           "n_docs long, n_tokens long")
     .coalesce(1).write.mode("overwrite").parquet(f"{at}/meta"))
    return gen


def load(spark: SparkSession, path: str) -> TextIndex:
    """The index as its last generation left it (S9).  Without patches the stored
    vectors are read; with them, they are weighted from the living counts. Texts and
    terms are views of the stored ones."""
    gens = generations(spark, path)
    index = STORE.load_index(spark, path)
    if not gens:
        return index
    n_docs, n_tokens = _sizes(spark, path, gens)
    deltas = [spark.read.parquet(f"{path}/patches/gen={g}/df").select("token", F.col("delta").alias("df"))
              for g in gens]
    df = index.model.idf.select("token", "df")
    for delta in deltas:
        df = df.unionByName(delta)
    df = df.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    idf = materialize(df.withColumn("idf", F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df")))
                                    + F.lit(1.0)), "idf", packed=True)
    model = enc.HashedModel(dim=index.model.dim, n_docs=n_docs, idf=idf)
    ends = _ends(spark, path, len(gens))
    texts, counts = _live(spark, path, "texts", ends), _live(spark, path, "counts", ends)
    vectors = materialize(enc.encode_rows(counts, model, "product_id"), "vectors", packed=True)
    return TextIndex(texts=texts, vectors=vectors, model=model, terms=enc.term_counts(counts, "product_id"),
                     n_tokens=n_tokens, counts=counts)


def follow(spark: SparkSession, path: str, texts: DataFrame) -> TextIndex:
    """S10 under change: the saved index, patched where the texts differ."""
    patch(spark, path, texts)
    return load(spark, path)


def compact(spark: SparkSession, path: str, out: str, config: dict) -> str:
    """Write the patched index as a base of its own under ``out``."""
    index = load(spark, path)
    fp = STORE.fingerprint(config, STORE.corpus_hash(index.texts))
    return STORE.save_index(index, out, config, fp)
