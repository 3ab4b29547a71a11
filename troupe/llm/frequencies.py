"""Frequency of every distinct term, by last-seen counters.

The deliveries of a record are reduced to one before they move, and records are then hash-partitioned by their
identifier and stream through in its order. For each term a counter holds its occurrences, its records and the last
record that it was seen in: a term met again in the record that it was last seen in is one more occurrence and no
further record, so no set of records is ever kept. A task's counters leave it whenever there are many, which is
always between two records; the counts of all tasks are added at the end, combined before they move. No term, however
frequent, and no marker that every record has is ever brought to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troupe.llm.terms import canonical_array
from troupe.runtime import materialize, width

#: Counters that a task holds before it hands them on.
HELD = 200_000
#: Stands for "has at least one term" among the terms; no canonical term begins with a space.
ANY = " any"


class Counters:
    """Of each term: occurrences, records, and the last record that it was seen in."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.occurrences, self.records, self.last = (np.zeros(1024, np.int64) for _ in range(3))

    def add(self, names: list[str], occurrences: np.ndarray, records: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Adds a run of records, of which `first` and `last` are those in which a term was seen first and last."""
        known = len(self.place)
        at = np.fromiter((self.place.setdefault(x, len(self.place)) for x in names), np.int64, len(names))
        if len(self.place) > len(self.last):
            grow = max(len(self.place), 2 * len(self.last)) - len(self.last)
            self.occurrences, self.records, self.last = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (self.occurrences, self.records, self.last))
        again = (at < known) & (self.last[at] == first)
        self.occurrences[at] += occurrences
        self.records[at] += records - again
        self.last[at] = last

    def batches(self) -> Iterator[pa.RecordBatch]:
        names, n = pa.array(list(self.place), pa.string()), len(self.place)
        whole = pa.RecordBatch.from_arrays([names, pa.array(self.occurrences[:n]), pa.array(self.records[:n])], ["term", "occurrences", "records"])
        for at in range(0, n, 10_000):
            yield whole.slice(at, 10_000)


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (record, terms), ordered by record, to (term, occurrences, records)."""
    held = Counters()
    for batch in batches:
        record, lists = batch.column(0).to_numpy(), batch.column(1)
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        coded = pc.dictionary_encode(canonical_array(lists.flatten()))
        code = pc.fill_null(coded.indices, -1).to_numpy()
        row, code = row[code >= 0], code[code >= 0]
        if not len(code):
            continue
        names = [*coded.dictionary.to_pylist(), ANY]
        # the marker is a term of every record that has any
        own = np.unique(row)
        row, code = np.concatenate([row, own]), np.concatenate([code, np.full(len(own), len(names) - 1)])
        pair, counts = np.unique(code * np.int64(batch.num_rows) + row, return_counts=True)
        term, at = np.divmod(pair, batch.num_rows)
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        ends = np.concatenate([starts[1:], [len(term)]])
        held.add([names[k] for k in term[starts].tolist()], np.add.reduceat(counts, starts), ends - starts, record[at[starts]], record[at[ends - 1]])
        if len(held.place) > HELD:
            yield from held.batches()
            held = Counters()
    yield from held.batches()


def _canonical_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([canonical_array(batch.column(0))], ["term"])


def term_frequencies(
    df: DataFrame, record: str, terms: str, vocabulary: DataFrame | None = None, word: str = "ngram", min_records: int = 3, max_share: float = 0.45
) -> DataFrame:
    """Counts of every distinct term of the array column `terms`: term, occurrences, records, mark.

    Terms are compared in canonical form; null, blank and empty ones don't count, nor do rows whose record is null
    or whose array is null. Rows of one record are repeated deliveries of the same content, of which one counts
    (should they differ, the one that sorts first). `vocabulary[word]` adds terms that may no longer occur, with
    counts of 0. mark is 'rare' below `min_records` records, 'common' above `max_share` of the records with at least
    one term, else null. An empty table gives only the vocabulary, or nothing."""
    source = df.select(F.col(record).cast("bigint").alias("record"), F.col(terms).alias("terms")).where("record is not null and terms is not null")
    once = source.groupBy("record").agg(F.min("terms").alias("terms"))
    counted = once.repartition(width(source), "record").sortWithinPartitions("record").mapInArrow(_last_seen, "term string, occurrences bigint, records bigint")
    if vocabulary is not None:
        extra = vocabulary.select(F.col(word)).mapInArrow(_canonical_column, "term string").where("term is not null")
        counted = counted.unionByName(extra.select("term", F.lit(0).cast("bigint").alias("occurrences"), F.lit(0).cast("bigint").alias("records")))
    totals = counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    # one row per term, read twice below
    totals = materialize(totals, "term-counts")
    # the number of records with a term is the count of one marker, sent to all as a single row
    total = totals.where(F.col("term") == ANY).agg(F.coalesce(F.max("records"), F.lit(0)).alias("total"))
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > max_share * F.col("total"), "common")
    return totals.where(F.col("term") != ANY).join(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))
