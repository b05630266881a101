"""Text chunks for retrieval: overlapping windows of words as Column expressions, and packing of paragraphs in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

MOST, OVERLAP, LEAST = 512, 64, 32
CHUNK = "array<struct<idx:int,text:string,tokens:int,overlap:int>>"


def windows(words: Column, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """array<struct<idx, text, tokens, overlap>> of windows over an array of words.

    Windows start every most - overlap words (half of most if that is not positive). A last window shorter than least
    joins the one before it, and there windows end.
    """
    stride = most - overlap if most > overlap else most // 2
    if stride < 1:
        raise ValueError("windows would not advance")
    n = F.size(words)
    # number of windows: up to the first that reaches the end
    count = F.greatest(F.ceil((n - most) / stride).cast("int") + 1, F.lit(1))
    tokens = lambda i: F.least(n - i * stride, F.lit(most))
    # with most < least every window but the first would be short, and the second ends it
    full = F.lit(least <= most)
    short = (count > 1) & F.when(full, tokens(count - 1) < least).otherwise(True)
    kept = F.when(short & ~full, F.lit(1)).otherwise(F.when(short, count - 1).otherwise(count))
    merged = F.when(full, tokens(count - 1)).otherwise(tokens(F.lit(1)))

    def one(i: Column) -> Column:
        body = F.array_join(F.slice(words, i * stride + 1, tokens(i)), " ")
        tail_start = F.when(full, (count - 1) * stride).otherwise(F.lit(stride))
        last = short & (i == kept - 1)
        tail = F.array_join(F.slice(words, tail_start + 1, F.greatest(merged, F.lit(1))), " ")
        return F.struct(
            i.cast("int").alias("idx"), F.when(last, F.concat(body, F.lit(" "), tail)).otherwise(body).alias("text"), (tokens(i) + F.when(last, merged).otherwise(0)).cast("int").alias("tokens"),
            F.when(i == 0, 0).otherwise(F.least(F.lit(overlap), i * stride)).cast("int").alias("overlap"),
        )

    return F.when(n == 0, F.array().cast(CHUNK)).otherwise(F.transform(F.sequence(F.lit(0), kept - 1), one))


def _pack(s: str, most: int, overlap: int, least: int) -> list[dict]:
    """Chunks of a text of several paragraphs: paragraphs are packed as long as they fit; a large one is cut into windows."""
    out: list[dict] = []
    held: list[str] = []
    size = 0

    def put(body: str, tokens: int) -> None:
        if tokens < least and out:
            out[-1]["text"] += "\n\n" + body
            out[-1]["tokens"] += tokens
        else:
            out.append({"idx": len(out), "text": body, "tokens": tokens, "overlap": 0})

    def flush() -> None:
        body = "\n\n".join(held).strip()
        if body:
            put(body, len(body.split()))

    for p in (x.strip() for x in s.split("\n\n")):
        words = p.split()
        if not words:
            continue
        if len(words) > most:
            flush()
            held, size = [], 0
            stride = most - overlap if most > overlap else most // 2
            first = len(out)
            for start in range(0, len(words), stride):
                part = words[start : start + most]
                if len(part) < least and len(out) > first:
                    out[-1]["text"] += " " + " ".join(part)
                    out[-1]["tokens"] += len(part)
                    break
                out.append({"idx": len(out), "text": " ".join(part), "tokens": len(part), "overlap": 0})
                if start + most >= len(words):
                    break
            continue
        if size + len(words) > most:
            flush()
            tail = "\n\n".join(held)
            if len(tail.split()) > overlap:
                tail = " ".join(tail.split()[len(tail.split()) - overlap :])
            held, size = ([tail], len(tail.split())) if tail else ([], 0)
        held.append(p)
        size += len(words)
    flush()
    for a, b in zip(out, out[1:], strict=False):
        x, y = a["text"].split(), b["text"].split()
        b["overlap"] = next((n for n in range(min(len(x), len(y)), 0, -1) if x[len(x) - n :] == y[:n]), 0)
    return out


def packed(c: Column | str, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    @F.pandas_udf(CHUNK)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else _pack(x, most, overlap, least))

    return run(c)


def chunk(c: Column | str, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Chunks of a text: itself if it is short, windows if it has one paragraph; those of several paragraphs come from packed().

    Only texts with several paragraphs need Python: see chunk_table.
    """
    x = F.col(c) if isinstance(c, str) else c

    def of(words: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("idx"), x.alias("text"), F.size(words).alias("tokens"), F.lit(0).alias("overlap"))).cast(CHUNK)
        return F.when(F.size(words) == 0, F.array().cast(CHUNK)).when(F.size(words) <= most, whole).otherwise(windows(words, most, overlap, least))

    # the words are an element of an array, so that they are split once and not for each use
    return F.get(F.transform(F.array(text.tokens(x)), of), F.lit(0))


def chunk_table(df: DataFrame, column: str = "text", most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """df with a row per chunk: its columns but the text, then idx, chunk_text, tokens, overlap."""
    several = F.col(column).contains("\n\n") & (F.size(text.blocks(column)) > 1)  # most texts have no such mark
    long = text.token_count(column) > most
    plain = df.where(~(several & long)).withColumn("chunk", F.explode(chunk(column, most, overlap, least)))
    rich = df.where(several & long).withColumn("chunk", F.explode(packed(column, most, overlap, least)))
    keep = [c for c in df.columns if c != column]
    cols = [F.col("chunk.idx").alias("idx"), F.col("chunk.text").alias("chunk_text"), F.col("chunk.tokens").alias("tokens"), F.col("chunk.overlap").alias("overlap")]
    return plain.select(*keep, *cols).unionByName(rich.select(*keep, *cols))


def computed_overlap(a: Column, b: Column) -> Column:
    """Most words at the end of one array that are the first ones of another."""
    n = F.least(F.size(a), F.size(b))
    sizes = F.filter(F.sequence(F.lit(0), n), lambda k: (k == 0) | (F.slice(a, F.size(a) - k + 1, F.greatest(k, F.lit(1))) == F.slice(b, F.lit(1), F.greatest(k, F.lit(1)))))
    return F.array_max(sizes)
