"""Growing a corpus along citations: bounded expansion, and what of it is new by an index of all that was seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_word, norm_doi, norm_title, strip
from ..storage import written
from .keys import first_wins
from .linkage import LETTERS, fuzzy_duplicates, lettered, similar_in_blocks

_BACKWARD, _FORWARD = "backward", "forward"


def expand(seeds: DataFrame, edges: DataFrame, works: DataFrame, depth: int = 1, ways: tuple[str, ...] = (_BACKWARD, _FORWARD)) -> DataFrame:
    """id, depth, parent, way, n_parents, and the columns of ``works``: what is reached from the seeds in ``depth`` steps.

    ``seeds``: id; ``edges``: citing, cited; ``works``: id and more, one row of each. A step goes from every work reached by the
    step before to what it cites (backward) and to what cites it (forward). A work keeps its first step; of the parents in that
    step the smallest (``n_parents`` of them), by the way that comes first in ``ways``. Seeds are no result, null ends and
    repeated edges count for nothing, unknown works have null columns. Works of many citations are
    joined as skewed keys, and each step's repeats are combined before anything is shuffled on.
    """
    plain = written(edges.select("citing", "cited").filter("citing is not null and cited is not null"), "steps")
    sides = {_BACKWARD: plain.select(F.col("citing").alias("parent"), F.col("cited").alias("id")), _FORWARD: plain.select(F.col("cited").alias("parent"), F.col("citing").alias("id"))}
    steps = reduce(lambda a, b: a.unionByName(b), [sides[w].withColumn("rank", F.lit(i)) for i, w in enumerate(ways)])
    frontier = written(seeds.select("id").filter("id is not null").distinct(), "frontier")
    visited, found = frontier, []
    for at in range(1, depth + 1):
        # the frontier has each work once, so it is hashed and the steps needn't be sorted
        met = steps.join(frontier.select(F.col("id").alias("parent")).hint("shuffle_hash"), "parent")
        first = met.groupBy("id").agg(F.min(F.struct("parent", "rank")).alias("first"), F.count_distinct("parent").alias("n_parents"))
        new = written(first.join(visited.hint("merge"), "id", "left_anti").select("id", F.lit(at).alias("depth"), "first.parent", "first.rank", "n_parents"), "reached")
        found.append(new)
        if at == depth or new.isEmpty():
            break
        frontier = new.select("id")
        visited = written(visited.unionByName(frontier), "visited")
    every = reduce(lambda a, b: a.unionByName(b), found)
    names = F.element_at(F.array(*map(F.lit, ways)), F.col("rank") + 1)
    return every.join(works.hint("merge"), "id", "left").withColumn("way", names).drop("rank")


class SeenIndex:
    """Records that have been seen, under ``folder``: DOIs, titles, and for each title of a block its letters, by which similar ones are found.

    Each batch that is added is a folder of its own, so a new batch is held against the index alone and
    nothing of it is rewritten. Titles are similar within a year and first word, by a token-sort
    ratio of ``threshold``: new titles meet seen ones of their block whose length and counted letters leave that possible
    (see ``linkage.similar_in_blocks``), and only these are compared.
    """

    _KEYS, _PIECES = "doi string, title string", "block string, id long, t string, len int, " + ", ".join(f"{k} long" for k in LETTERS)

    def __init__(self, spark: SparkSession, folder: str, threshold: int = 92):
        self.spark, self.folder, self.threshold = spark, folder.rstrip("/"), threshold

    def _batches(self) -> int:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/keys")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath() for x in files.listStatus(place)] if files.exists(place) else []
        return sum(files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) for p in names)

    def _table(self, name: str, schema: str) -> DataFrame:
        n = self._batches()
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{name}/v{i}" for i in range(n))) if n else self.spark.createDataFrame([], schema)

    @staticmethod
    def _keyed(records: DataFrame) -> DataFrame:
        norm = norm_title(F.col("title"))
        return records.select(
            "*", norm_doi(F.col("doi")).alias("_doi"), F.nullif(F.lower(strip(F.col("title"))), F.lit("")).alias("_title"),
            F.concat_ws(" ", F.coalesce("year", F.lit(0)).cast("string"), first_word(norm)).alias("_block"), F.array_join(F.array_sort(F.split(norm, " ")), " ").alias("_t"),
        )

    def add(self, records: DataFrame) -> None:
        """Take up records (doi, title, year). The titles go first; a batch counts once its keys are complete."""
        at, keyed = self._batches(), written(self._keyed(records).select("_doi", "_title", "_block", "_t").distinct(), "taken-up")
        titles = keyed.filter("_t <> ''").select(F.col("_block").alias("block"), F.col("_t").alias("t")).distinct().withColumn("id", F.monotonically_increasing_id() + (at << 48))
        lettered(titles, "t", ["block"]).write.mode("overwrite").parquet(f"{self.folder}/pieces/v{at}")
        keyed.select(F.col("_doi").alias("doi"), F.col("_title").alias("title")).distinct().write.mode("overwrite").parquet(f"{self.folder}/keys/v{at}")

    def _similar(self, keyed: DataFrame) -> DataFrame:
        """pos of records with a title similar to one that was seen."""
        seen = self._table("pieces", self._PIECES)
        asks = keyed.filter("_t <> ''").select(F.col("_block").alias("block"), "_t").distinct().withColumn("id", F.monotonically_increasing_id())
        asks = lettered(asks, "_t", ["block"])
        near = written(similar_in_blocks(asks, seen, ["block"], self.threshold).select("x").distinct(), "near-seen")
        found = asks.join(near.hint("merge"), F.col("id") == F.col("x"), "left_semi").select(F.col("block").alias("_block"), F.col("t").alias("_t"))
        return keyed.join(written(found, "similar-seen").hint("merge"), ["_block", "_t"]).select("pos")

    def new(self, records: DataFrame) -> DataFrame:
        """Of the records those that are new: first by DOI and by title against all seen, then of each DOI and each
        title of their own the first in order of pos, then by similar titles against all seen, and last among
        themselves (of similar ones the richer stays, see ``linkage.fuzzy_duplicates``).

        Reads pos, doi, title, year and what richness reads. Blank keys match nothing.
        """
        keyed = written(self._keyed(records), "arrived")
        seen = self._table("keys", self._KEYS)
        fresh = keyed
        for own, known in (("_doi", "doi"), ("_title", "title")):
            fresh = fresh.join(seen.select(F.col(known).alias("_k")).filter("_k is not null").distinct().hint("merge"), F.col(own) == F.col("_k"), "left_anti")
        fresh = written(first_wins(written(fresh, "unseen"), ["_doi"], "pos"), "first-of-doi")
        fresh = written(first_wins(fresh, ["_title"], "pos"), "first-of-title")
        fresh = written(fresh.join(self._similar(fresh).distinct().hint("merge"), "pos", "left_anti"), "dissimilar")
        lost = written(fuzzy_duplicates(fresh, self.threshold).select("pos"), "lost")
        return fresh.join(lost.hint("merge"), "pos", "left_anti").select(*records.columns)
