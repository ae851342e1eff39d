"""Documents into containers of a fixed number of tokens, by bounded-space online packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.tokens import VOCABULARY, token_counts
from tidewater.runtime import cut_lineage

CAPACITY = 2_048
#: Open windows of a partition, and partitions whose leftovers are merged by one task.
OPEN_WINDOWS, MERGED_PARTITIONS = 64, 64
#: Items of a window after which one without size makes it close, so that empty texts don't pile up in memory.
MOST_ITEMS = 10_000

_ROWS = "doc_id bigint, piece_no int, n_pieces int, container_id bigint, tokens bigint, container_fill bigint, merge_group int"
_COLUMNS = [c.split()[0] for c in _ROWS.split(", ")]


class Windows:
    """A fixed number of open windows; an item goes to the one it fills best."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.items: dict[int, list] = {}
        self.opened = 0

    def place(self, size: int, item) -> list[tuple[int, int, list]]:
        """Place an item; the windows closed by that, as (window, fill, items)."""
        closed = []
        at = bisect_left(self.room, (size, -1))
        if not size and at < len(self.room) and len(self.items[self.room[at][1]]) >= MOST_ITEMS:  # items without size could join one window for ever
            closed.append(self._close(at))
            at = len(self.room)
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most_open:
                closed.append(self._close(0))
            room, window = self.capacity, self.opened
            self.opened += 1
            self.items[window] = []
        self.items[window].append(item)
        if room == size:
            closed.append((window, self.capacity, self.items.pop(window)))
        else:
            insort(self.room, (room - size, window))
        return closed

    def _close(self, at: int) -> tuple[int, int, list]:
        room, window = self.room.pop(at)
        return window, self.capacity - room, self.items.pop(window)

    def rest(self) -> list[tuple[int, int, list]]:
        """The windows still open."""
        return [self._close(0) for _ in range(len(self.room))]


def pack_documents(
    documents: DataFrame,
    *,
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    most_open: int = OPEN_WINDOWS,
    merged_partitions: int = MERGED_PARTITIONS,
) -> DataFrame:
    """The container of every document: ``doc_id, piece_no, n_pieces, container_id, tokens, container_fill``.

    Documents are packed where they lie, in one pass and without moving text: each partition keeps ``most_open`` windows,
    places a document where it leaves the least room, and emits the fullest window when none has room. Only a document
    larger than ``capacity`` is split: into full containers and a rest that is packed like a document. The windows left at
    the end of ``merged_partitions`` partitions are merged with each other (largest first, best fit), whole windows at a
    time, so container ids stay unique. A null or empty text has no tokens and joins the window with the least room.
    Repeated rows are packed each on their own. Ids are of any kind that casts to bigint; null ids are kept. An empty
    table gives no rows.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        group, base = pid // merged_partitions, pid << 36
        windows = Windows(capacity, most_open)
        out: list[tuple] = []

        def emit(closed: list[tuple[int, int, list]], merge_group: int) -> None:
            for window, fill, items in closed:
                out.extend((doc, piece, pieces, base + window, size, fill, merge_group) for doc, piece, pieces, size in items)

        for pdf in batches:
            for doc, size in zip(pdf["doc_id"], token_counts(pdf["text"], vocabulary)):
                doc = None if pd.isna(doc) else int(doc)
                full, rest = divmod(size, capacity)
                pieces = max(1, full + (rest > 0))
                for k in range(full):
                    out.append((doc, k, pieces, base + windows.opened, capacity, capacity, -1))
                    windows.opened += 1
                if rest or not full:
                    emit(windows.place(rest, (doc, full, pieces, rest)), -1)
            if len(out) >= 20_000:
                yield _frame(out)
                out = []
        emit(windows.rest(), group)
        yield _frame(out)

    placed = cut_lineage(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(pack, _ROWS))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        fills = pdf.groupby("container_id")["container_fill"].first().sort_values(ascending=False, kind="stable")
        room: list[tuple[int, int]] = []
        target: dict[int, int] = {}
        for window, fill in fills.items():
            at = bisect_left(room, (fill, -1))
            left, into = room.pop(at) if at < len(room) else (capacity, window)
            target[window] = into
            insort(room, (left - fill, into))
        filled = {into: capacity - left for left, into in room}
        container = pdf["container_id"].map(target)
        return pdf.assign(container_id=container, container_fill=container.map(filled))

    done = placed.where(F.col("merge_group") < 0)
    merged = placed.where(F.col("merge_group") >= 0).groupBy("merge_group").applyInPandas(merge, _ROWS)
    return done.unionByName(merged).drop("merge_group")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def container_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers by tenths of their fill: ``fill_tenth`` (0 to 10), ``containers``, ``tokens``."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return (
        per.groupBy(F.floor(F.col("tokens") * 10 / capacity).cast("int").alias("fill_tenth"))
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    )


def packing_faults(documents: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that holds a packing against its promises: ``documents, placed`` (first pieces), ``overfull`` containers, ``torn``
    (pieces of documents that fit a container, or pieces before the last that don't fill theirs), ``lost`` (documents with pieces missing)."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.max("container_fill").alias("fill"))
    full = per.agg(F.count_if((F.col("tokens") > capacity) | (F.col("tokens") != F.col("fill"))).alias("overfull"))
    torn = (F.col("n_pieces") > 1) & (F.col("piece_no") < F.col("n_pieces") - 1) & (F.col("tokens") != capacity)
    pieces = packed.agg(
        F.count_if(F.col("piece_no") == 0).alias("placed"),
        F.count_if(torn).alias("torn"),
        (F.sum(F.when(F.col("piece_no") == 0, F.col("n_pieces"))) - F.count(F.lit(1))).alias("lost"),
    )
    everything = documents.agg(F.count(F.lit(1)).alias("documents"))
    one = F.lit(1).alias("one")  # three tables of one row
    out = everything.select("*", one).join(pieces.select("*", one), "one").join(full.select("*", one), "one")
    return out.select("documents", "placed", "overfull", "torn", F.coalesce("lost", F.lit(0)).alias("lost"))
