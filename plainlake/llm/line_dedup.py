"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainlake.llm.shared import Workspace, ascii_lower, ascii_space_trim, free_names, row_key

RUN = ["h1", "h2", "n_docs", "keeper"]


class Runs:
    """Sorted runs of (line hash, documents that hold it, largest doc_id) in levels, as in a log-structured merge tree.

    add() splits the keys of a batch by a merge anti-join with the runs: new keys become one run of level 0, sorted by
    hash, so that every key is in one run only; known keys go to a run of updates, which all() adds to them. When a level
    holds `fanout` runs, they are merged into one sorted run of the next level, so that a key is rewritten once a level
    and a lookup meets at most (fanout - 1) runs a level. Updates are levelled alike. Batches must not share documents.
    """

    def __init__(self, ws: Workspace, fanout: int = 3):
        self.ws, self.fanout, self.made = ws, fanout, 0
        self.levels: list[list[DataFrame]] = []
        self.updates: list[list[DataFrame]] = []

    def _write(self, levels: list[list[DataFrame]], run: DataFrame, level: int = 0) -> DataFrame:
        while len(levels) <= level:
            levels.append([])
        self.made += 1
        made = self.ws.save(run.sortWithinPartitions("h1", "h2"), f"run-{level}-{self.made}")
        levels[level].append(made)
        if len(levels[level]) >= self.fanout:
            runs, levels[level] = levels[level], []
            self._write(levels, self._merged(runs), level + 1)
        return made

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")) if len(runs) > 1 else both

    def add(self, lines: DataFrame) -> None:
        """Rows (h1, h2, doc): any number a key and document."""
        once = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).cast("long").alias("one"))
        batch = once.groupBy("h1", "h2").agg(F.sum("one").alias("n_docs"), F.max("doc").alias("keeper"))
        if not self.levels:
            self._write(self.levels, batch)
            return
        batch = self.ws.save(batch, f"batch-{self.made}")
        new = self._write(self.levels, self.unseen(batch))
        self._write(self.updates, batch.join(new.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"))

    def all(self) -> DataFrame:
        return self._merged([r for level in self.levels + self.updates for r in level])

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows whose hash is in no run: one merge-anti-join a run, smallest runs last."""
        for level in reversed(self.levels):
            for run in level:
                lines = lines.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return lines


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc, _k1, _k2, pos) of the lines whose key has least_chars code points."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), *row_key("doc_id", "text"), "text")
    rows = keyed.select("doc", "_k1", "_k2", F.posexplode(_lines()).alias("pos", "line"))  # beside it, the keys would be hashed anew for every line
    rows = rows.withColumn("line", ascii_space_trim(F.col("line"))).filter(F.length("line") >= least_chars).withColumn("line", ascii_lower(F.col("line")))
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(11), "line").alias("h2"), "doc", "_k1", "_k2", "pos")


def dedup_lines(docs: DataFrame, ws: Workspace, least_chars: int = 40, least_docs: int = 5, batches: int = 4, fanout: int = 3, out: str = "kept_text") -> DataFrame:
    """`docs` with n_lines, n_dropped and `out`: the text without its repeated lines.

    A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased. Keys of at least
    `least_chars` code points that at least `least_docs` documents hold lose all their lines except in the largest doc_id.
    Other lines stay in their order. Null and empty text is one empty line; a text may be of any length. Rows that share a doc_id count as one document;
    a null doc_id is the smallest of all. Equal rows each lose the same lines. Columns named as the new ones give way; others may have any name. An empty table
    gives an empty table.

    The text is read twice. First, hashes and places of the long lines are written, dealt into `batches` by doc_id; every
    batch is split by the `Runs` so far and adds its own. Then the lines are joined to the frequent keys and the places to drop go to their document;
    the text of a document is shuffled once, and a line that a third of the documents hold is counted before any shuffle.
    """
    at = ws.save(long_lines(docs, least_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")), "lines")
    runs = Runs(ws, fanout)
    for b in range(batches):
        runs.add(at.filter(F.col("batch") == b).select("h1", "h2", "doc"))
    frequent = ws.save(runs.all().filter(F.col("n_docs") >= least_docs).select("h1", "h2", "keeper"), "frequent")
    drop = at.join(frequent, ["h1", "h2"]).filter("doc < keeper").groupBy("_k1", "_k2", "pos").agg(F.lit(1).alias("_one"))
    drop = drop.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list("pos")).alias("_drop"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", out)]
    k1, k2, gone, parts = free_names(docs, 4)
    rows = docs.withColumns(dict(zip((k1, k2), row_key("doc_id", "text"))))
    rows = rows.join(drop.withColumnsRenamed({"_k1": k1, "_k2": k2, "_drop": gone}).hint("shuffle_hash"), [k1, k2], "left").withColumn(parts, _lines())
    gone, parts = F.col(gone), F.col(parts)
    # The kept lines are the runs between two dropped places, so the work is linear in the lines of a document.
    first = lambda i: F.when(i == 0, 0).otherwise(F.element_at(gone, F.greatest(i, F.lit(1))) + 1)
    last = lambda i: F.when(i == F.size(gone), F.size(parts)).otherwise(F.element_at(gone, F.least(i + 1, F.size(gone))))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(parts, first(i) + 1, last(i) - first(i))))
    n_dropped = F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped")
    text = F.when(gone.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias(out)
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.size(parts).cast("long").alias("n_lines"), n_dropped, text)
