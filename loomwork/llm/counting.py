"""Token counts that follow edits: segment trees over a document's pre-tokens.

A leaf holds up to LEAF pre-tokens: its characters and tokens; an inner node holds its children's sums. An edit
(start, end, replacement; code points) descends to the leaves it touches, goes back to a pre-token border that the edit can't
reach, splits and encodes from there until a border of the old text is met again, and puts the new leaves in place of the old
ones with the sums above them. A pre-token depends on its own characters and on as
many that follow as the longest added token has, as one may begin there; that is the context kept.

Nulls: a null text counts as empty (no tokens). Edits of a null document id or of unknown documents have no effect; bounds are
clipped to the text; edits of a document apply in the order of `seq` and then of their fields, each to the text that the one
before left. Repeated document rows each get the edits; equal edits apply one after the
other. Texts of any length have one tree. Without rows the result is empty. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.tokens import default_path, encoder

LEAF = 64
TREE = "leaf_chars array<int>, leaf_tokens array<int>"


class Tree:
    """Leaves of a text with sums above them in one array each (node 1 is the root)."""

    def __init__(self, text: str, path: str, leaf: int = LEAF, leaves: tuple[list[int], list[int]] | None = None):
        self.text, self.leaf, self.enc = text, leaf, encoder(path)
        self.encoded = 0
        if leaves is None:
            words = self.enc.split(text)
            leaves = self._leaves(words)
        self._build(*leaves)

    def _leaves(self, words: list[str]) -> tuple[list[int], list[int]]:
        self.encoded += len(words)
        n = [len(x) // 4 for x in self.enc.each(words)]
        chars = list(map(len, words))
        cuts = range(0, len(words), self.leaf)
        return [sum(chars[i : i + self.leaf]) for i in cuts], [sum(n[i : i + self.leaf]) for i in cuts]

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.n = len(chars)
        self.width = 1 << max(0, (self.n - 1).bit_length())
        pad = [0] * (self.width - self.n)
        self.chars, self.tokens = [0] * self.width + chars + pad, [0] * self.width + tokens + pad
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.width : self.width + self.n], self.tokens[self.width : self.width + self.n]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last for the end) and where it starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, start: int, end: int, new: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        text = self.text[:start] + new + self.text[end:]
        if not self.n or not text:
            self.text = text
            self._build(*self._leaves(self.enc.split(text)))
            return
        first, a = self.find(max(0, start - self.enc.context - 1))
        # back to a leaf's start that the edit can't reach: leaves start at pre-token borders
        while first and a + self.enc.context > start:
            first -= 1
            a -= self.chars[self.width + first]
        last, b = self.find(min(end, size - 1))
        b += self.chars[self.width + last]
        delta = len(new) - (end - start)
        # borders of the old text behind the edit, a leaf's end each time, until the new text has one there too
        words: list[str] = []
        while True:
            words = self.enc.split(text[a : b + delta + self.enc.context + 1] if b < size else text[a:])
            if b >= size:
                break
            at, k, need = a, 0, b + delta
            while k < len(words) and at < need:
                at += len(words[k])
                k += 1
            if at == need and b >= end:
                words = words[:k]
                break
            last += 1
            b += self.chars[self.width + last]
        mid = self._leaves(words)
        chars, tokens = self.leaves()
        self.text = text
        if len(mid[0]) == last + 1 - first:
            for k in range(len(mid[0])):
                self._set(first + k, mid[0][k], mid[1][k])
        else:
            self._build(chars[:first] + mid[0] + chars[last + 1 :], tokens[:first] + mid[1] + tokens[last + 1 :])

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.width + leaf
        self.chars[i], self.tokens[i] = chars, tokens
        i //= 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2


def count(docs: DataFrame, path: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the leaves of each document's tree, which `apply` takes."""
    path = path or default_path()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [[], [], []]
            for text in b.column(1):
                t = Tree(text.as_py() or "", path, leaf)
                chars, tokens = t.leaves()
                out[0].append(t.total)
                out[1].append(chars)
                out[2].append(tokens)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in out[1:])], names=["doc_id", "n_tokens", "leaf_chars", "leaf_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {TREE}")


def recount(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """docs has doc_id, text, edits array<struct<seq int, start int, stop int, put string>> and, if known, leaf_chars and leaf_tokens.

    Returns doc_id, n_tokens (before), n_edited (after), n_encoded (pre-tokens encoded for the edits), n_chars (after) and the new leaves.
    """
    path = path or default_path()
    known = "leaf_chars" in docs.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for r in zip(*(b.column(i) for i in range(b.num_columns)), strict=True):
                text, edits = r[1].as_py() or "", r[2].as_py() or []
                leaves = (r[3].as_py(), r[4].as_py()) if known and r[3].is_valid and r[4].is_valid else None
                t = Tree(text, path, leaf, leaves)
                before, t.encoded = t.total, 0
                for e in sorted(edits, key=lambda e: (e["seq"] or 0, e["start"] or 0, e["stop"] or 0, e["put"] or "")):
                    t.edit(e["start"] or 0, e["stop"] if e["stop"] is not None else len(t.text), e["put"] or "")
                for col, v in zip(cols, (before, t.total, t.encoded, len(t.text), *t.leaves()), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_tokens", "n_edited", "n_encoded", "n_chars", "leaf_chars", "leaf_tokens"])

    cols = ["doc_id", "text", "edits", *(("leaf_chars", "leaf_tokens") if known else ())]
    return docs.select(*cols).mapInArrow(run, f"doc_id long, n_tokens long, n_edited long, n_encoded long, n_chars long, {TREE}")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Gathers edits(doc_id, seq, start, stop, put) beside their documents; a document's own edits must fit in a row."""
    own = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct("seq", "start", "stop", "put")).alias("edits"))
    return docs.join(own, "doc_id", "left")
