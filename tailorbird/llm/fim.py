"""Fill-in-middle by piece tables.

A document is a descriptor (buffer, start, length) over an immutable text; cutting splits a descriptor in two, and an
arrangement is a permutation of the three pieces and the three sentinels, which are descriptors over a second buffer.
No text moves until an output is asked for. An output is taken apart again at its sentinels, and the inverse
permutation puts its pieces back. Hashes stream over the descriptors, a bounded part of a piece at a time.

All counts are code points. Cuts and form come from the id alone (SHA-256 of salt and id), so a repeated id is cut at
the same shares and a run that is repeated gives the same rows.

Cases: null texts are empty, and empty texts and those that hold a sentinel stay plain; a null id counts as an empty
one; repeated rows give repeated rows; other columns are left out unless `carry` names them, and a name of a result
among these is an error.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PIECE = "struct<buffer:int,start:int,length:int>"
SENTINELS = ("<P>", "<S>", "<M>")
RESULT = ("n", "form", "prefix_chars", "middle_chars", "pieces", "output")

#: Places in the table (prefix, middle, suffix, and their three sentinels in the order of SENTINELS) as each form shows them.
ARRANGED = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}


def piece(buffer: int, start, length) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), F.lit(start).cast("int").alias("start"), F.lit(length).cast("int").alias("length"))


def cut(whole: Column, at: Column) -> tuple[Column, Column]:
    """Two descriptors for one: its first `at` code points, and the rest."""
    at = at.cast("int")
    left = whole.withField("length", at)
    return left, F.struct(whole["buffer"].alias("buffer"), (whole["start"] + at).alias("start"), (whole["length"] - at).alias("length"))


def sentinel_pieces(sentinels: tuple[str, str, str]) -> list[Column]:
    starts = [sum(map(len, sentinels[:k])) for k in range(3)]
    return [piece(1, at, len(s)) for at, s in zip(starts, sentinels)]


def rendered(pieces: Column, text: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that descriptors stand for, over a text and the sentinels."""
    own = lambda d: F.when(d["buffer"] == 0, text).otherwise("".join(sentinels))
    return F.array_join(F.transform(pieces, lambda d: F.substring(own(d), d["start"] + 1, d["length"])), "")


def piece_hash(text: Column, pieces: Column, sentinels: tuple[str, str, str] = SENTINELS, part: int = 1 << 16) -> Column:
    """SHA-256, in lowercase hex, of what the descriptors stand for; the text of all of them together is never built."""
    fixed = "".join(sentinels)

    @F.arrow_udf(StringType())
    def streamed(texts: pa.Array, tables: pa.Array) -> pa.Array:
        out = []
        for text, table in zip(texts, tables):
            buffers, h = (text.as_py(), fixed), hashlib.sha256()
            for d in table.as_py():
                whole, end = buffers[d["buffer"]], d["start"] + d["length"]
                for at in range(d["start"], end, part):
                    h.update(whole[at : min(at + part, end)].encode())
            out.append(h.hexdigest())
        return pa.array(out, pa.string())

    return streamed(text, pieces)


def draws(doc_id: Column, salt: str) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, percent: int = 90, spm_percent: int = 20, salt: str = "1:", sentinels: tuple[str, str, str] = SENTINELS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, text (never null), n, form (plain, psm or spm), prefix_chars, middle_chars, pieces and output.

    `percent` of the documents are transformed, of these `spm_percent` with the suffix first. Null lengths mark plain ones.
    """
    if clash := [c for c in carry if c.lower() in ("doc_id", "text", *RESULT)]:
        raise ValueError(f"columns {clash} have the name of a result")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    one, two, three, four = draws(F.col("doc_id"), salt)
    n, marked = F.char_length("text"), F.lit(False)
    for s in sentinels:
        marked = marked | F.col("text").contains(s)
    form = F.when((n == 0) | marked | (three % 100 >= percent), "plain").when(four % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("*", n.cast("long").alias("n"), form.alias("form"), one.alias("_a"), two.alias("_b"))
    at = [F.col(c) % (F.col("n") + 1) for c in ("_a", "_b")]
    rows = rows.select("doc_id", "text", *carry, "n", "form", F.least(*at).alias("_first"), F.greatest(*at).alias("_second"))
    prefix, rest = cut(piece(0, 0, F.col("n")), F.col("_first"))
    middle, suffix = cut(rest, F.col("_second") - F.col("_first"))
    table = (prefix, middle, suffix, *sentinel_pieces(sentinels))
    pieces = F.array(piece(0, 0, F.col("n")))
    for name, order in ARRANGED.items():
        pieces = F.when(F.col("form") == name, F.array(*[table[i] for i in order])).otherwise(pieces)
    cut_up = F.col("form") != "plain"
    rows = rows.select(
        "doc_id", "text", *carry, "n", "form", F.when(cut_up, F.col("_first")).alias("prefix_chars"),
        F.when(cut_up, F.col("_second") - F.col("_first")).alias("middle_chars"), pieces.alias("pieces"),
    )
    return rows.withColumn("output", rendered(F.col("pieces"), F.col("text"), sentinels))


def restored_pieces(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The descriptors, over an output, of the document that it was made of.

    No text that was cut holds a sentinel, and none can come about where one meets a text, as sentinels begin and end with
    signs that they hold nowhere else: each stands once.
    """
    size = F.char_length(output)
    out = F.array(piece(0, 0, size))
    for name, order in ARRANGED.items():
        marks = [sentinels[i - 3] for i in order[::2]]
        begin = [F.locate(m, output) - 1 for m in marks]
        inside = [b + len(m) for b, m in zip(begin, marks)]
        content = [piece(0, a, z - a) for a, z in zip(inside, [*begin[1:], size])]
        inverse = sorted(range(3), key=[order[2 * k + 1] for k in range(3)].__getitem__)
        out = F.when(form == name, F.array(*[content[k] for k in inverse])).otherwise(out)
    return out


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The document that an output was made of."""
    return rendered(restored_pieces(output, form, sentinels), output, sentinels)
