"""Segments of documents that meet by a key, of which each task finds the windows that occur first.

A unit (a bucket of documents) sends segments, runs of consecutive windows, as rows (h, bucket, doc, pos, id, k2, text): h
is a function of every window in the segment, so equal windows meet. Documents are ordered by (id, k2); where these are
equal they are of one unit, and doc, their number in it, decides. Rows come to a task sorted by h. They are
taken in collections that end between keys. A key that goes on beyond `largest` rows is worked off in parts: of a part
only segments that are first with some window stay for the next part, as what is first of all is first in its part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOVED = "h long, bucket int, doc int, pos long, id long, k2 long, text binary"
ANSWER = "unit int, doc int, pos long, windows int, mask long"


def table(columns: list, names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    columns = columns or [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class Group:
    """Sent segments, sorted by key, as columns."""

    def __init__(self, h, bucket, doc, pos, id_, k2, text: list[bytes]) -> None:
        self.columns, self.text = (h, bucket, doc, pos, id_, k2), text

    @staticmethod
    def of(b: pa.RecordBatch) -> Group:
        return Group(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(6)), b.column(6).to_pylist())

    @staticmethod
    def joined(parts: list[Group]) -> Group:
        return Group(*(np.concatenate(x) for x in zip(*(p.columns for p in parts), strict=True)), [t for p in parts for t in p.text])

    def take(self, at: np.ndarray) -> Group:
        return Group(*(c[at] for c in self.columns), [self.text[i] for i in at.tolist()])

    def __len__(self) -> int:
        return len(self.text)

    def shared(self) -> np.ndarray:
        """Those whose key others have too."""
        same = self.columns[0][1:] == self.columns[0][:-1]
        return np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))

    def ranks(self) -> np.ndarray:
        """Numbers that order the segments' documents."""
        _, _, doc, _, id_, k2 = self.columns
        order = np.lexsort((doc, k2, id_))
        new = np.zeros(len(order), np.uint64)
        new[1:] = (id_[order][1:] != id_[order][:-1]) | (k2[order][1:] != k2[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        out = np.empty(len(order), np.uint64)
        out[order] = np.cumsum(new)
        return out

    def answers(self, at: np.ndarray, mask: np.ndarray, windows: Callable[[bytes], int]) -> pa.RecordBatch:
        _, bucket, doc, pos, *_ = self.columns
        return table([bucket[at], doc[at], pos[at], [windows(self.text[i]) for i in at.tolist()], mask[at].view(np.int64)], ANSWER).to_batches()[0]


def firsts_of(moved: DataFrame, parts: int, masks: Callable[[Group], np.ndarray], batch: int, largest: int, windows: Callable[[bytes], int] = len) -> DataFrame:
    """A row for each sent segment: unit, doc, pos, windows, and mask: bit i is set if its window at i is the first of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Group] = []
        for b in batches:
            for a in range(0, b.num_rows, batch):
                held.append(Group.of(b.slice(a, batch)))
                if sum(map(len, held)) < batch:
                    continue
                all_ = Group.joined(held)
                cut = int(np.searchsorted(all_.columns[0], all_.columns[0][-1]))
                if cut:
                    done = all_.take(np.arange(cut))
                    yield done.answers(np.arange(cut), masks(done), windows)
                rest = all_.take(np.arange(cut, len(all_))) if cut else all_
                if len(rest) >= largest:
                    mask = masks(rest)
                    gone = np.flatnonzero(mask == 0)
                    if len(gone):
                        yield rest.answers(gone, mask, windows)
                        rest = rest.take(np.flatnonzero(mask))
                held = [rest] if len(rest) else []
        if held:
            all_ = Group.joined(held)
            yield all_.answers(np.arange(len(all_)), masks(all_), windows)

    return moved.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, ANSWER)
