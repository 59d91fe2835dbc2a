"""Filings: HTML to text, sections, sentences and section sentiment. Works on whole texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.words import NEGATIVE, POSITIVE, hits, text_column

# Section headings (case-insensitive).
HEADINGS = {
    "item_1a": r"\bitem\s*1\s*a[\.\:\s]",
    "item_7": r"\bitem\s*7[\.\:\s]",
    "item_7a": r"\bitem\s*7\s*a[\.\:\s]",
    "item_8": r"\bitem\s*8[\.\:\s]",
    "part1_item2": r"\bpart\s*i\s+item\s*2[\.\:\s]",
    "part1_item3": r"\bpart\s*i\s+item\s*3[\.\:\s]",
    "part2_item1a": r"\bpart\s*ii\s+item\s*1\s*a[\.\:\s]",
    "part2_item2": r"\bpart\s*ii\s+item\s*2[\.\:\s]",
}
# Section -> (start, end, fallback end) per form family.
SECTIONS = {
    "10-K": {"risk_factors": ("item_1a", "item_7", None), "mda": ("item_7", "item_7a", "item_8"),
             "market_risk": ("item_7a", "item_8", None)},
    "10-Q": {"risk_factors": ("part2_item1a", "part2_item2", None), "mda": ("part1_item2", "part1_item3", None),
             "market_risk": ("part1_item3", "part2_item1a", "part2_item2")},
}
SECTION_NAMES = ["risk_factors", "mda", "market_risk"]
LONGEST = 40_000


def decode_entities(c: Column) -> Column:
    """Numeric and named character references as characters; unknown ones stay.

    The text is cut at references, so that each is decoded once and what it gives is not read again.
    """
    names = F.create_map(*[F.lit(x) for name, plain in html5.items() if name.endswith(";") for x in (f"&{name}", plain)])
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(&#[xX][0-9a-fA-F]{1,7};?|&#[0-9]{1,8};?|&[A-Za-z][A-Za-z0-9]{0,31};|&[^&]*|[^&]+)"), F.lit(1))
    # numbers of the C1 range mean the characters of Windows-1252
    western = F.create_map(*[F.lit(x) for k in range(0x80, 0xA0) for x in (k, bytes([k]).decode("cp1252", "replace").replace("\ufffd", chr(k)))])

    def character(number: Column) -> Column:
        bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        return F.when(bad, F.lit("\ufffd")).when(number.between(0x80, 0x9F), F.element_at(western, number.cast("int"))).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))

    def plain(part: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("long")
        decimal = F.regexp_extract(part, "^&#([0-9]+)", 1).cast("long")
        return F.when(part.rlike("^&#[xX][0-9a-fA-F]"), character(hexadecimal)).when(part.rlike("^&#[0-9]"), character(decimal)).when(
            part.rlike("^&[A-Za-z][A-Za-z0-9]*;$"), F.coalesce(F.element_at(names, part), part)).otherwise(part)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, plain), "")).otherwise(c)


def table_parts(html: Column) -> Column:
    """A page cut before each opening and after each closing of a table."""
    return F.split(F.regexp_replace(html, r"(?i)</table\s*>", "</table>"), r"(?i)(?=<table\b)|(?<=</table>)")


def table_depths(html: Column, step, start: Column, finish):
    """Fold over the parts of a page with the depth before a part's end and after it."""
    opens = lambda p: p.rlike(r"(?i)^<table\b").cast("int")
    closes = lambda p: p.endswith("</table>").cast("int")

    def fold(a, p):
        inside = a["depth"] + opens(p)
        after = F.greatest(inside - closes(p), F.lit(0))
        return step(a, p, inside > 0, after)

    return F.aggregate(table_parts(html), start, fold, finish)


def drop_tables(c: Column) -> Column:
    """The text outside of tables, whatever their nesting; a table that never ends is kept."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit("").alias("held"))

    def step(a, p, inside, after):
        ended = inside & (after == 0)
        out = F.when(ended, F.concat(a["out"], F.lit(" "))).when(inside, a["out"]).otherwise(F.concat(a["out"], p))
        held = F.when(inside & ~ended, F.concat(a["held"], p)).otherwise(F.lit(""))
        return F.struct(after.alias("depth"), out.alias("out"), held.alias("held"))

    return F.when(c.rlike(r"(?i)<table\b"), table_depths(c, step, start, lambda a: F.concat(a["out"], a["held"]))).otherwise(c)


def strip_tags(html: str | Column) -> Column:
    """Drop scripts, styles, comments and tables with their content, tags become spaces and
    character references are decoded."""
    c = text_column(html)
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(drop_tables(c), r"(?s)<[^>]+>", " ")
    return decode_entities(c)


def normalise_space(text: str | Column) -> Column:
    c = F.regexp_replace(text_column(text), " ", " ")
    c = F.regexp_replace(c, "​", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def between(text: str | Column, start: str, end: str, fallback: str | None = None) -> Column:
    """Text after the second start heading (the first if there is one only) up to the next end
    heading, else the fallback heading, else the end; empty without a start."""
    parts = F.split(text_column(text), f"(?i){HEADINGS[start]}", 3)
    rest = F.coalesce(F.get(parts, F.lit(2)), F.get(parts, F.lit(1)))

    def cut(pattern: str) -> Column:
        # a heading starting exactly where the section starts does not end it
        return F.get(F.split(rest, f"(?i)(?<=.){HEADINGS[pattern]}", 2), F.lit(0))

    def found(pattern: str) -> Column:
        return F.regexp_instr(rest, F.lit(f"(?is)(?<=.){HEADINGS[pattern]}")) > 0

    section = F.when(found(end), cut(end))
    if fallback:
        section = section.when(found(fallback), cut(fallback))
    return F.coalesce(F.trim(section.otherwise(rest)), F.lit(""))


def parse_filings(filings: DataFrame, text: str = "text", is_html: bool = True) -> DataFrame:
    """Add the three sections by form, lengths and ``is_empty``; other forms have empty
    sections. A filing without text goes through with ``bad`` set."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = filings.withColumn("_plain", normalise_space(strip_tags(raw) if is_html else raw))
    sections = {}
    for name in SECTION_NAMES:
        picked = F.lit("")
        for family, spec in SECTIONS.items():
            picked = F.when(F.col("form").startswith(family), between("_plain", *spec[name])).otherwise(picked)
        sections[name] = picked
    rows = rows.withColumns(sections)
    lengths = {f"len_{s}": F.length(s) for s in SECTION_NAMES}
    rows = rows.withColumn("raw_length", F.length("_plain")).withColumns(lengths)
    total = sum((F.col(f"len_{s}") for s in SECTION_NAMES), F.lit(0))
    return rows.withColumns({"is_empty": total == 0, "bad": F.col(text).isNull()}).drop("_plain", text)


def truncate_middle(text: str | Column, longest: int = LONGEST, joint: str = " ... ") -> Column:
    """Head and tail of over-long texts, joined by an ellipsis."""
    c = text_column(text)
    half = longest // 2
    return F.when(F.length(c) <= longest, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit(joint), F.right(c, F.lit(half))))


def unpivot_sections(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, section_name, text) for the three sections."""
    return parsed.unpivot(list(keys), SECTION_NAMES, "section_name", "text")


def sentences(text: str | Column, shortest: int = 30) -> Column:
    """Trimmed sentences of at least ``shortest`` characters."""
    parts = F.transform(F.split(text_column(text), r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= shortest)


def lexicon_probabilities(sentence: str | Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """struct(p_pos, p_neg, p_neu) from word hits with one count for neutral; the default scorer."""
    p, n = hits(sentence, positive), hits(sentence, negative)
    total = (p + n + 1).cast("double")
    return F.struct((p / total).alias("p_pos"), (n / total).alias("p_neg"), (1.0 / total).alias("p_neu"))


Scorer = Callable[[pd.Series], pd.DataFrame]


def score_sentences(rows: DataFrame, scorer: Scorer | None = None, positive: Sequence[str] = POSITIVE,
                    negative: Sequence[str] = NEGATIVE) -> DataFrame:
    """Add p_pos, p_neg, p_neu to a ``sentence`` column. A scorer maps an Arrow batch of strings
    to three columns; without one the lexicon expression is used."""
    if scorer is None:
        return rows.withColumn("_p", lexicon_probabilities("sentence", positive, negative)).select("*", "_p.*").drop("_p")
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p_pos", "p_neg", "p_neu")])

    @F.pandas_udf(schema)
    def apply(batch: pd.Series) -> pd.DataFrame:
        return scorer(batch)

    return rows.withColumn("_p", apply("sentence")).select("*", "_p.*").drop("_p")


def section_sentiment(sections: DataFrame, keys: Sequence[str], scorer: Scorer | None = None,
                      positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> DataFrame:
    """(keys, n_sentences, mean_score, frac_positive, frac_negative, frac_neutral) of ``text``."""
    keys = list(keys)
    rows = sections.select(*keys, F.explode(sentences("text")).alias("sentence"))
    return roll_up_sentences(sections.select(*keys), score_sentences(rows, scorer, positive, negative), keys)


def roll_up_sentences(all_keys: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means and argmax shares; ties go to positive, then negative. Keys without sentences: zeros."""
    keys = list(keys)
    p, n, u = F.col("p_pos"), F.col("p_neg"), F.col("p_neu")
    top = F.when((p >= n) & (p >= u), 0).when(n >= u, 1).otherwise(2)
    count = F.count(F.lit(1))
    stats = scored.groupBy(*keys).agg(
        count.alias("n_sentences"), F.avg(p - n).alias("mean_score"),
        *[(F.count_if(top == i) / count).alias(name) for i, name in enumerate(("frac_positive", "frac_negative", "frac_neutral"))])
    zeros = {"n_sentences": 0, "mean_score": 0.0, "frac_positive": 0.0, "frac_negative": 0.0, "frac_neutral": 0.0}
    return all_keys.distinct().join(stats, keys, "left").na.fill(zeros)


def embed_sections(sections: DataFrame, embed: Callable[[pd.Series], pd.Series] | None = None, dim: int = 256) -> DataFrame:
    """Add a unit ``embedding`` of ``text``; empty texts give the zero vector.

    ``embed`` maps an Arrow batch of whole texts to lists of floats; a model with a limit gets texts that went
    through ``truncate_middle`` first. The default counts words in ``dim`` buckets of their
    hashes with the built-in feature transformers.
    """
    if embed is not None:

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def apply(batch: pd.Series) -> pd.Series:
            return embed(batch)

        return sections.withColumn("embedding", apply("text"))
    from pyspark.ml.feature import CountVectorizerModel, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    # 32 bits of a word's md5, so that other engines can repeat it
    bucket = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("string"))
    counter = CountVectorizerModel.from_vocabulary([str(k) for k in range(dim)], inputCol="_buckets", outputCol="_tf")
    counted = counter.transform(sections.withColumn("_buckets", F.coalesce(bucket, F.array().cast("array<string>"))))
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit")).drop("_buckets", "_tf", "_unit")
