"""Language identification by interpolated Kneser-Ney character models.

Each language has counts of character n-grams; probabilities of all orders are computed once for every n-gram seen in any
language and kept in arrays sorted by the n-grams' 64-bit hashes, with one column for each language. A text's language is the
one of least cross-entropy for each character. It is rejected (column `rejected`) if that cross-entropy lies above what texts
of the language held back from the fit have, by a margin that widens for short texts.

The models are fitted on a bounded sample: about `sample` texts for each language, taken by a hash of the id; of texts longer
than `longest` characters windows from all parts, by a hash, so many characters together. Every value of lang is learned.
Predictions read whole texts. Languages with fewer than `ENOUGH` texts held back are judged by those of all languages, and where
these are too few, too, by what a text of random letters would have.

Nulls: a null text, or one without a letter, is `und` with score 0 and rejected. Rows of a null language are not learned from;
a null id is learned from or not as the empty text's checksum says. If no language can be learned, all is `und`. Repeated rows
are all returned; equal cross-entropies go to the language that sorts first. Further columns stay; where they have the name of
a column that `predict` adds, the new one has underscores after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import fresh, give_back

ORDER = 4
SAMPLE = 1200
LONGEST = 20_000
#: Characters of a window of a text that is longer than `longest`.
PIECE = 2000
#: Nats for each character above a language's own mean, and standard errors, from which a text is rejected.
MARGIN, ERRORS = 1.0, 4.0
ENOUGH = 5
CHUNK = 1 << 17
ROWS = 250
_M = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    """Lower-case letters with one blank for all between words; empty if there is no letter.

    Words with digits in them (keys, codes, addresses) say little of a language and are left out, if others are there.
    """
    import regex

    if not hasattr(normal, "sub"):
        normal.sub = regex.compile(r"[^\p{L}\p{M}]+").sub
        normal.mixed = regex.compile(r"(?<!\S)[^\s\p{N}]*+\p{N}\S*+").sub
        normal.digit = regex.compile(r"\p{N}").search
    if not text:
        return ""
    low = text.lower()
    plain = normal.mixed(" ", low) if normal.digit(low) else low
    s = normal.sub(" ", plain).strip() or normal.sub(" ", low).strip()
    return s if any(map(str.isalpha, s)) else ""


def windows(text: str, longest: int) -> str:
    """The text, or windows from each of its parts, placed by a hash, of `longest` characters together."""
    from xxhash import xxh64_intdigest

    if len(text) <= longest:
        return text
    many = max(1, longest // PIECE)
    part, size = len(text) // many, longest // many
    return " ".join(text[a : a + size] for i in range(many) for a in [i * part + xxh64_intdigest(f"{i} {len(text)}") % (part - size + 1)])


def grams(codes, order: int = ORDER):
    """Hashes of the 1- to order-grams that end at each place; the first order - 1 places are not to be used."""
    import numpy as np

    out = [codes.astype(np.uint64) + np.uint64(1)]
    for _ in range(order - 1):
        prev = np.empty_like(out[-1])
        prev[0], prev[1:] = 0, out[-1][:-1]
        out.append(prev * np.uint64(_M) + out[0])
    return out


def codes_of(texts: list[str]):
    """Code points of texts, each after ORDER - 1 blanks and before one, with the places where they start and their sizes."""
    import numpy as np

    pad = " " * (ORDER - 1)
    joined = "".join(f"{pad}{s} " for s in texts)
    size = np.array([len(s) + ORDER for s in texts])
    return np.frombuffer(joined.encode("utf-32-le"), dtype="<u4"), np.cumsum(size) - size, size


def _find(table, keys):
    """Places of keys in a sorted array and whether they are there."""
    import numpy as np

    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Model:
    """For each order k: `keys[k]` sorted hashes, `logp[k]` (n-grams x languages); `ctx[k]`, `back[k]` weights of the shorter context."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.keys, self.logp, self.ctx, self.back = {}, {}, {}, {}
        self.floor = None
        self.mean = self.sd = None

    @classmethod
    def fit(cls, langs: list[str], rows) -> "Model":
        """rows: arrays lang (index), g1..gN (hashes of the suffixes), ctx (hash of the first N - 1), count of distinct N-grams."""
        import numpy as np

        m, n_lang = cls(langs), len(langs)
        lang, count = rows["lang"], rows["count"].astype(np.float64)
        # the hash of a context of k characters: the (k + 1)-gram is context * M + last
        last = rows["g1"]
        inverse = np.uint64(pow(_M, -1, 1 << 64))
        prefix = {k: (rows[f"g{k}"] - last) * inverse for k in range(2, ORDER + 1)}
        m.floor = np.zeros(n_lang)
        for x in range(n_lang):
            m.floor[x] = 1.0 / (len(np.unique(last[lang == x])) + 1)
        below, below_keys = None, None
        for k in range(1, ORDER + 1):
            key = rows[f"g{k}"]
            if k == ORDER:
                c_lang, c_key, c = lang, key, count
                c_ctx, c_suf = prefix[k], rows[f"g{k - 1}"]
            else:
                # continuation counts: distinct (k + 1)-grams that end in this k-gram
                pair = np.unique(np.stack([lang.astype(np.uint64), rows[f"g{k + 1}"], key, last]), axis=1)
                trip, c = np.unique(pair[[0, 2, 3]], axis=1, return_counts=True)
                c_lang, c_key, c = trip[0].astype(np.int64), trip[1], c.astype(np.float64)
                c_ctx = (trip[1] - trip[2]) * inverse if k > 1 else np.zeros(len(c), dtype=np.uint64)
                if k > 1:
                    first = {int(g): i for i, g in enumerate(key)}
                    at = np.array([first[int(g)] for g in c_key])
                    c_suf = rows[f"g{k - 1}"][at]
            keys = np.unique(c_key)
            ctx = np.unique(c_ctx)
            gi, hi = np.searchsorted(keys, c_key), np.searchsorted(ctx, c_ctx)
            total, kinds = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
            np.add.at(total, (hi, c_lang), c)
            np.add.at(kinds, (hi, c_lang), 1)
            disc = np.zeros(n_lang)
            for x in range(n_lang):
                own = c[c_lang == x]
                n1, n2 = (own == 1).sum(), (own == 2).sum()
                disc[x] = n1 / (n1 + 2 * n2) if n1 and n1 + 2 * n2 else 0.5
            disc = np.clip(disc, 0.1, 0.95)
            back = np.where(total > 0, disc * kinds / np.maximum(total, 1), 1.0)
            suffix, context = np.zeros(len(keys), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
            context[gi] = c_ctx
            if k > 1:
                suffix[gi] = c_suf
                low = below[np.searchsorted(below_keys, suffix)]
            else:
                low = np.tile(m.floor, (len(keys), 1))
            hk = np.searchsorted(ctx, context)
            p = back[hk] * low
            np.add.at(p, (gi, c_lang), np.maximum(c - disc[c_lang], 0) / total[hi, c_lang])
            m.keys[k], m.logp[k], m.ctx[k], m.back[k] = keys, np.log(p), ctx, np.log(back)
            below, below_keys = p, keys
        m.floor = np.log(m.floor)
        m.mean, m.sd = np.zeros(n_lang), np.zeros(n_lang)
        return m

    def logs(self, g, i):
        """Log probabilities (places i x languages) of the characters there, given those before."""
        import numpy as np

        inverse = np.uint64(pow(_M, -1, 1 << 64))
        out = np.zeros((len(i), len(self.langs)))
        rest = np.arange(len(i))
        for k in range(ORDER, 0, -1):
            key = g[k - 1][i[rest]]
            at, hit = _find(self.keys[k], key)
            out[rest[hit]] += self.logp[k][at[hit]]
            rest, key = rest[~hit], key[~hit]
            if not len(rest):
                return out
            ctx = (key - g[0][i[rest]]) * inverse if k > 1 else np.zeros(len(rest), dtype=np.uint64)
            at, hit = _find(self.ctx[k], ctx)
            out[rest[hit]] += self.back[k][at[hit]]
        out[rest] += self.floor
        return out

    def entropies(self, texts: list[str]):
        """Nats for each character: texts x languages; texts are normal and not empty."""
        import numpy as np

        sums, sizes = np.zeros((len(texts), len(self.langs))), np.array([len(s) + 1 for s in texts])
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
                n += len(texts[j])
                j += 1
            if j == i + 1 and n > CHUNK:  # a long text by parts, each with the characters before it
                s = texts[i]
                for a in range(0, len(s), CHUNK):
                    part = s[max(0, a - ORDER + 1) : a + CHUNK]
                    skip = min(a, ORDER - 1)
                    end = a + CHUNK >= len(s)
                    c = np.frombuffer(((" " * (ORDER - 1 - skip)) + part + " " * end).encode("utf-32-le"), dtype="<u4")
                    sums[i] += self._sum(c, np.array([0]), np.array([len(c)]))[0]
            else:
                sums[i:j] = self._sum(*codes_of(texts[i:j]))
            i = j
        return sums / sizes[:, None], sizes

    def _sum(self, codes, starts, sizes):
        """Nats of each of the texts laid end to end; the first ORDER - 1 places of each only give context."""
        import numpy as np

        g = grams(codes)
        _, first, back = np.unique(g[-1], return_index=True, return_inverse=True)
        # the same n-gram may end at a place that is not to be used: any place gives the same hashes but near the very start
        first = np.maximum(first, 0)
        logs = self.logs(g, first)
        use = np.ones(len(codes), dtype=bool)
        for k in range(ORDER - 1):
            use[starts + k] = False
        out = np.zeros((len(starts), len(self.langs)))
        for x in range(len(self.langs)):
            v = np.where(use, logs[:, x][back], 0.0)
            out[:, x] = -np.add.reduceat(v, starts)
        return out


def train(docs: DataFrame, learn, sample: int = SAMPLE, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on rows of docs where `learn` holds; a tenth of the sample is kept to calibrate the rejection."""
    import numpy as np

    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    many = rows.groupBy("lang").count().collect()  # a row for each language
    if not many:
        return None
    langs = sorted(r["lang"] for r in many)
    share = {r["lang"]: min(1.0, sample / r["count"]) for r in many}
    place = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_000)) / 1_000_000
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    taken = rows.withColumn("place", place).withColumn("share", limit[F.col("lang")]).where("place < share").withColumn("held", F.col("place") >= F.col("share") * 0.9)
    index = {x: i for i, x in enumerate(langs)}

    def count(batches):
        import pyarrow as pa

        names = ["lang", *(f"g{k}" for k in range(1, ORDER + 1))]
        parts: list = []
        for b in batches:
            by: dict[int, list[str]] = {}
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s := normal(windows(t, longest)):
                    by.setdefault(index[x], []).append(s)
            for x, texts in by.items():
                codes, starts, _ = codes_of(texts)
                g = grams(codes)
                use = np.ones(len(codes), dtype=bool)
                for k in range(ORDER - 1):
                    use[starts + k] = False
                _, first, n = np.unique(g[-1][use], return_index=True, return_counts=True)
                at = np.flatnonzero(use)[first]
                parts.append([np.full(len(at), x), *(h[at].view(np.int64) for h in g), n])
        if parts:
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            for i in range(0, len(cols[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 18)].astype(np.int64)) for c in cols], names=[*names, "n"])

    gcols = [f"g{k}" for k in range(1, ORDER + 1)]
    got = taken.where("not held").select("lang", "text").mapInArrow(count, "lang long, " + ", ".join(f"{c} long" for c in gcols) + ", n long")
    # as many rows as the sample has distinct n-grams: the sample is bounded, so are they
    t = got.groupBy("lang", *gcols).agg(F.sum("n").alias("n")).toArrow()
    if not t.num_rows:
        return None
    data = {"lang": t["lang"].to_numpy().astype(np.int64), "count": t["n"].to_numpy(), **{c: t[c].to_numpy().view(np.uint64) for c in gcols}}
    m = Model.fit(langs, data)

    def held(batches):
        import pyarrow as pa

        for b in batches:
            pairs = [(index[x], s) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(s := normal(t)) > 20]
            if pairs:
                ce, size = m.entropies([s for _, s in pairs])
                x = np.array([k for k, _ in pairs])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(ce[np.arange(len(x)), x]), pa.array(size)], names=["lang", "ce", "size"])

    kept = taken.where("held").select("lang", "text").mapInArrow(held, "lang long, ce double, size long").toArrow().to_pydict()
    x, ce, n = (np.array(kept[c], dtype=np.float64) for c in ("lang", "ce", "size"))

    def usual(own):
        mean = np.median(ce[own])
        return mean, np.median(np.abs(ce[own] - mean) * np.sqrt(n[own])) * 1.4826

    all_ = usual(np.ones(len(x), dtype=bool)) if len(x) >= ENOUGH else None
    for i in range(len(langs)):
        own = x == i
        # else a text worse than random letters is rejected
        m.mean[i], m.sd[i] = usual(own) if own.sum() >= ENOUGH else all_ or (-m.floor[i] - MARGIN, 0.0)
    return m


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and lang_pred, score, cross_entropy and rejected as the last four."""
    added = []
    for name in ("lang_pred", "score", "cross_entropy", "rejected"):
        added.append(fresh([*docs.columns, *added], name))
    if model is None or not model.langs:
        return docs.withColumns(dict(zip(added, (F.lit("und"), F.lit(0.0), F.lit(None).cast("double"), F.lit(True)), strict=True)))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the bounded sample of each language makes it
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(added, kinds, strict=True))])
    names = docs.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = sent.value
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = [normal(x.as_py()) for x in b.column(names.index(text_col))]
            keep = [i for i, s in enumerate(texts) if s]
            pred, score, ent, rej = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), dtype=bool)
            if keep:
                ce, size = m.entropies([texts[i] for i in keep])
                best = ce.argmin(axis=1)
                low = ce[np.arange(len(best)), best]
                soft = np.exp(-np.clip((ce - low[:, None]) * np.minimum(size, 40)[:, None], 0, 700))
                above = low > m.mean[best] + MARGIN + ERRORS * m.sd[best] / np.sqrt(size)
                for k, i in enumerate(keep):
                    pred[i] = m.langs[best[k]]
                score[keep], ent[keep], rej[keep] = 1 / soft.sum(axis=1), low, above
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(pred), pa.array(score), pa.array(ent, mask=np.isnan(ent)), pa.array(rej)], names=[*names, *added])
        give_back()

    return docs.mapInArrow(run, schema)
