"""Which pages of a combined factsheet, and which lines on them, belong to which scheme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that make a line a scheme's title, its longest length, and how many lines away a caption may stand.
TITLE_WORDS = ("fund", "fof", "etf")
TITLE_LENGTH, CAPTION_LINES = 100, 3
#: Phrases printed beside the title on a scheme's own page, without blanks and marks.
CAPTIONS = ("typeofscheme", "detailsason", "categoryofscheme", "openended")
CAPTION_WORD = "erstwhile"
#: Heads of pages that repeat every scheme's title for its risk, likewise; in the first so many lines.
RISK_HEADS = ("riskometerason", "riskometersason", "productlabelingandriskometer", "productlabellingandriskometer")
HEAD_LINES = 3


def name_key(name: Column) -> Column:
    """What two spellings of a scheme's name have in common: its letters and digits, in lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def brand_of(name: Column) -> Column:
    """The key of a name's first word, which the titles of one house share."""
    return name_key(F.get(F.split(F.trim(name), r"\s+"), F.lit(0)))


def is_caption(line: Column) -> Column:
    key = name_key(line)
    said = key.contains(CAPTIONS[0])
    for caption in CAPTIONS[1:]:
        said = said | key.contains(caption)
    return said | F.array_contains(F.regexp_extract_all(F.lower(line), F.lit("[a-z]+"), 0), CAPTION_WORD)


def is_title(line: Column) -> Column:
    named = F.arrays_overlap(F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}_]+"), 0), F.array(*map(F.lit, TITLE_WORDS)))
    return (F.length(line) <= TITLE_LENGTH) & named


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r]"), lambda x: F.trim(x) != "")


def page_titles(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, titles) of pages (doc_id, page_number, text): place and key of every line that may be a scheme's
    title, as it has a caption within three lines. Pages of risk labels have none. All within each page's row."""
    rows = pages.select("doc_id", "page_number", lines_of(F.col("text")).alias("lines"))
    risky = F.exists(F.slice("lines", 1, HEAD_LINES), lambda x: F.exists(F.array(*map(F.lit, RISK_HEADS)), lambda h: name_key(x).contains(h)))
    rows = rows.filter(~risky).withColumn("captions", F.transform("lines", is_caption))
    begin = lambda i: F.greatest(i - CAPTION_LINES, F.lit(0))
    beside = lambda i: F.exists(F.slice("captions", begin(i) + 1, i - begin(i) + CAPTION_LINES + 1), lambda c: c)
    lines = F.transform("lines", lambda x, i: F.struct(i.alias("at"), name_key(x).alias("key"), (is_title(x) & beside(i)).alias("title")))
    found = F.transform(F.filter(lines, lambda x: x["title"]), lambda x: F.struct(x["at"].alias("at"), x["key"].alias("key")))
    return rows.select("doc_id", "page_number", found.alias("titles")).filter(F.size("titles") > 0)


def scheme_segments(pages: DataFrame, schemes: DataFrame) -> DataFrame:
    """(doc_id, page_number, scheme_id, text, sole_title): the text of each scheme (scheme_id, name) on its own pages of
    factsheets (doc_id, page_number, text). A page is a scheme's if one of its titles is the scheme's name. If
    another scheme of the house has a title there too, the text goes from the scheme's first title to the next of
    another one; else it is the whole page, as what belongs to it may stand above the title. Titles of one house begin
    with the name's first word. A scheme whose name no title equals has no pages, never all of them.

    Titles meet schemes by equality of keys, and only pages with a match give their texts to the result."""
    titles = page_titles(pages)
    asked = schemes.select("scheme_id", name_key(F.col("name")).alias("key"), brand_of(F.col("name")).alias("brand")).filter("key <> ''")
    each = titles.select("doc_id", "page_number", "titles", F.explode(F.array_distinct(F.transform("titles", lambda t: t["key"]))).alias("key"))
    found = each.join(asked, "key")
    key, brand = F.col("key"), F.col("brand")
    of_house = F.filter("titles", lambda t: t["key"].startswith(brand))
    start = F.array_min(F.transform(F.filter(of_house, lambda t: t["key"] == key), lambda t: t["at"]))
    found = found.select("doc_id", "page_number", "scheme_id", "key", of_house.alias("titles"), start.alias("start"))
    after = F.array_min(F.transform(F.filter("titles", lambda t: (t["at"] > F.col("start")) & (t["key"] != key)), lambda t: t["at"]))
    sole = ~F.exists("titles", lambda t: t["key"] != key)
    found = found.select("doc_id", "page_number", "scheme_id", "start", after.alias("stop"), sole.alias("sole_title"))
    rows = found.join(pages.select("doc_id", "page_number", "text"), ["doc_id", "page_number"])
    lines = lines_of(F.col("text"))
    own = F.array_join(F.slice(lines, F.col("start") + 1, F.coalesce("stop", F.size(lines)) - F.col("start")), "\n")
    return rows.select("doc_id", "page_number", "scheme_id", F.when(F.col("sole_title"), F.col("text")).otherwise(own).alias("text"), "sole_title")


def attributed(pages: DataFrame, schemes: DataFrame) -> DataFrame:
    """The pages of combined factsheets as pages of each scheme's own document, for the parsers of managers and costs:
    doc_id (the document's and the scheme's), source_doc, scheme_id, page_number, text, shared."""
    rows = scheme_segments(pages, schemes)
    return rows.select(F.concat_ws("/", "doc_id", "scheme_id").alias("doc_id"), F.col("doc_id").alias("source_doc"), "scheme_id", "page_number", "text", (~F.col("sole_title")).alias("shared"))
