"""Rows with every odd case, and brute-force twins."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}

ODD = [
    (1, "the cat sat on the mat and looked at the moon all night", "en", "s", "clash"),
    (2, "the cat sat on the mat and looked at the moon all night", "en", "s", "clash"),
    (2, "the cat sat on the mat and looked at the moon all night", "en", "s", "clash"),
    (3, None, None, None, None),
    (None, "a row without an id", "en", "s", None),
    (4, "", "en", "s", "x"),
    (5, "   \n\t ", "de", "s", "x"),
    (6, "word " * 5000, "en", "s", "x"),
    (7, "Ünïcödé 漢字   \U0001f600 text <|endoftext|> it's", "fr", "s", "x"),
    (8, "one", "en", None, "x"),
    (9, "x" * 3000, "en", "s", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, length string"


def docs(spark, rows=ODD):
    """The column `length` clashes with what operators add."""
    return spark.createDataFrame(rows, SCHEMA)


def save(spark, tmp_path, rows=ODD):
    docs(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def encode(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(encode, "t"):
        encode.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return encode.t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def words(text):
    return WORD.findall((text or "").translate(LOWER))
