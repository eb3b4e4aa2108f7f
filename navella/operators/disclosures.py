"""Page texts, links, names and events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navella.functions.dates import MONTHS, leading_date

#: The standard headings of scheme documents, looked for at the start of a line.
HEADINGS = (
    "Investment Objective",
    "Investment Strategy",
    "Asset Allocation Pattern",
    "Risk Factors",
    "Fund Manager",
    "Load Structure",
    "Expenses of the Scheme",
)
#: Words of a scheme's name that tell nothing.
STOP_WORDS = ("fund", "plan", "scheme", "the", "of", "direct", "regular", "growth", "option")


def headings(text: Column) -> Column:
    """The headings that stand at the start of a line."""
    known = F.array(*map(F.lit, HEADINGS))
    return F.filter(known, lambda h: F.regexp_like(text, F.concat(F.lit(r"(?im)^\s*"), h, F.lit(r"\b"))))


def parse_status(pages: DataFrame) -> DataFrame:
    """For each document (pages: doc_id, page_number, text; a document without pages has a row of null page_number) the share
    of pages with text and its status: parsed with text on any page, unparseable_scanned without, unparseable without
    pages."""
    filled = F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    found = pages.groupBy("doc_id").agg(F.count("page_number").alias("pages"), filled.alias("filled"))
    share = F.coalesce(F.try_divide("filled", "pages"), F.lit(0.0))
    status = F.when(F.col("pages") == 0, "unparseable").when(share == 0, "unparseable_scanned").otherwise("parsed")
    return found.select("doc_id", "pages", share.alias("share"), status.alias("status"))


def occurrences(text: Column, terms: list[str]) -> Column:
    """Number of non-overlapping occurrences of all terms in lower-cased text."""
    low = F.lower(text)
    return sum(((F.length(low) - F.length(F.replace(low, F.lit(t)))) / len(t) for t in map(str.lower, terms)), F.lit(0.0)).cast("long")


TRUNCATED = "…[truncated]"


def search_pages(pages: DataFrame, terms: list[str] | str, max_chars: int, wanted: list[str] | None = None) -> DataFrame:
    """Pages with the terms, most occurrences first, within a budget of characters for each document; the page that exceeds
    it is cut and marked. terms: words, or a text of which the runs of letters, digits and apostrophes are; without any all
    pages count, in their order. wanted: only pages with one of these headings, in whatever case. Pages are ranked by their
    lengths and scores; only those that stay are given their text again."""
    terms = re.findall(r"[A-Za-z0-9']+", terms) if isinstance(terms, str) else terms
    known = [h for h in HEADINGS if wanted is not None and h.lower() in {w.lower() for w in wanted}]
    pages = pages if wanted is None else pages.filter(F.arrays_overlap(headings(F.col("text")), F.array(*map(F.lit, known)).cast("array<string>")))
    rows = pages.select("doc_id", "page_number", occurrences(F.col("text"), terms).alias("score"), F.length("text").alias("size"))
    rows = rows.filter("score > 0") if terms else rows.filter("size is not null")
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "page_number")
    rows = rows.withColumns({"rank": F.row_number().over(order), "before": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    left = F.least(F.col("size"), F.lit(max_chars) - F.col("before")).cast("int")
    rows = rows.filter(F.col("before") < max_chars).withColumn("left", left)
    text = F.when(F.col("size") <= F.col("left"), F.col("text")).otherwise(F.concat(F.col("text").substr(F.lit(1), F.col("left")), F.lit(TRUNCATED)))
    return pages.join(rows, ["doc_id", "page_number"]).select("doc_id", "page_number", "score", "rank", F.col("left").cast("long").alias("chars"), text.alias("text"))


def excerpts(pages: DataFrame, heading: str, most_pages: int = 2, max_chars: int = 3000) -> DataFrame:
    """The first pages of each document with a heading, each cut to so many characters."""
    rows = pages.filter(F.array_contains(headings(F.col("text")), heading))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))).filter(F.col("nth") <= most_pages)
    return rows.select("doc_id", "page_number", F.substring("text", 1, max_chars).alias("excerpt"))


def file_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Distinct link targets of every page, with the address they lead to from the page's own, whether they are of a
    spreadsheet or PDF file, and the first day of the month or the day that the file's name tells."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']([^\"']*)[\"']"), 1), lambda h: F.trim(h)))
    rows = pages.select("page_id", F.coalesce(F.col(url), F.lit("")).alias("own"), F.explode(targets).alias("href"))
    scheme, host = F.regexp_extract("own", r"^([a-z][a-z0-9+.-]*:)//", 1), F.regexp_extract("own", r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract("own", r"^([a-z][a-z0-9+.-]*://[^?#]*/)", 1)
    href = F.col("href")
    base = F.coalesce(F.nullif(folder, F.concat(scheme, F.lit("//"))), F.concat(host, F.lit("/")))
    absolute = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(base, href))
    return rows.select("page_id", "href", absolute.alias("address"), F.lower("href").rlike(r"\.(xlsx|xls|pdf)$").alias("is_file"), file_date(href).alias("file_date"))


def file_date(name: Column) -> Column:
    """The first of the month that a file's name tells: Mar 2024, Mar2024, 2024-03-15."""
    last = F.regexp_extract(name, r"([^/]*)/*$", 1)
    word = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*[_\- ]?\s*(\d{4})"
    words = F.try_to_date(F.concat_ws(" ", F.initcap(F.regexp_extract(last, word, 1)), F.regexp_extract(last, word, 2)), "MMM yyyy")
    day = F.try_to_date(F.concat(F.regexp_extract(last, r"(\d{4}-\d{2})-\d{2}", 1), F.lit("-01")), "yyyy-MM-dd")
    return F.coalesce(words, day)


def loose_date(text: Column) -> Column:
    """The first date in a text, in any form that leading_date reads."""
    pieces = F.split(text, rf"(?i)(?=\b(?:\d|{'|'.join(m[:3] for m in MONTHS)}))")
    dates = F.transform(pieces, lambda _, i: leading_date(F.array_join(F.slice(pieces, i + 1, 6), "")))
    return F.get(F.filter(dates, lambda x: x.isNotNull()), F.lit(0))


def event_id(*parts: Column) -> Column:
    """The same event always gets the same id."""
    return F.concat(F.lit("evt-"), F.substring(F.sha1(F.concat_ws("::", *parts)), 1, 16))


def freshness(documents: DataFrame, as_of: str, expected: dict[str, int]) -> DataFrame:
    """For each kind of document (doc_type, doc_date), and each house where the documents have one (amc_id), the newest date,
    its age and whether it is older than expected."""
    gap = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    keys = [c for c in ("amc_id", "doc_type") if c in documents.columns]
    found = documents.groupBy(*keys).agg(F.max("doc_date").alias("newest"), F.count("*").alias("n"))
    found = found.withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), "newest"))
    return found.withColumn("status", F.when(F.col("age_days") > F.coalesce(F.try_element_at(gap, "doc_type"), F.lit(60)), "degraded").otherwise("ok"))


def history(rows: DataFrame, day: str, since: str, schemes: DataFrame | None = None) -> DataFrame:
    """Rows of snapshots, derivatives, ratios or documents of a day (a column) since another one, of all schemes or of those
    asked for (scheme_id); both conditions reach the scan."""
    found = rows.filter(F.col(day) >= F.lit(since).cast("date"))
    return found if schemes is None else found.join(schemes.select("scheme_id").distinct(), "scheme_id", "left_semi")


def words(name: Column) -> Column:
    """Distinct lower-cased words of a name, compounds of cap parted, without stop words."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")
    parted = F.regexp_replace(plain, r"\b(mid|small|large|flexi|multi|micro)cap\b", "$1 cap")
    return F.array_except(F.split(F.trim(parted), " "), F.array(*map(F.lit, (*STOP_WORDS, ""))))


def resolve(queries: DataFrame, schemes: DataFrame, limit: int) -> DataFrame:
    """The schemes (scheme_id, name) that hold all words of each query (query_id, text); ranked by confidence, then by how many
    further words the name has. An inverted index is asked for each text's rarest word alone, so a word that most names have
    is only looked up for texts of nothing rarer; the other words are checked on what it finds. Equal texts are resolved
    once, and each of their queries gets what was found."""
    asked = queries.select("text").distinct().withColumn("q", words(F.col("text")))
    named = schemes.select("scheme_id", "name", words(F.col("name")).alias("w"))
    known = named.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    each = asked.select("text", "q", F.explode("q").alias("word")).join(known, "word", "left")
    rarest = each.groupBy("text", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rarest")).filter("rarest.n > 0")
    index = named.select("scheme_id", "name", "w", F.explode("w").alias("word"))
    rows = rarest.select("text", "q", "rarest.word").join(index, "word").filter(F.size(F.array_except("q", "w")) == 0)
    low, ask = F.lower("name"), F.lower("text")
    confidence = F.when(low == ask, 0.95).when(low.contains(ask), 0.7).otherwise(0.6)
    rows = rows.select("text", "scheme_id", "name", confidence.alias("confidence"), F.size(F.array_except("w", "q")).alias("extra"))
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("confidence"), "extra", "scheme_id"))
    best = rows.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return queries.select("query_id", "text").distinct().join(best, "text").select("query_id", "scheme_id", "name", "confidence", "extra", "rank")


#: Characters of the longest runs by which texts are looked for within others.
GRAM = 3


def grams(text: Column, k: int) -> Column:
    """The distinct runs of k characters of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(text, i, F.lit(k)))
    return F.when(F.length(text) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(q, s) of each text (q, not empty) and string (s) that holds it, both distinct. Strings are indexed by their runs of up to
    three characters; a text is looked up by its rarest run of three, or, if it is shorter, by itself, and what that
    finds is checked."""
    index = strings.select("s", F.explode(F.concat(*(grams(F.col("s"), k) for k in range(1, GRAM + 1)))).alias("gram"))
    known = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("q") < GRAM, F.array("q")).otherwise(grams(F.col("q"), GRAM))
    each = texts.select("q", F.explode(own).alias("gram")).join(known, "gram", "left")
    rarest = each.groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")).filter("rarest.n > 0")
    return rarest.select("q", "rarest.gram").join(index, "gram").filter(F.col("s").contains(F.col("q"))).select("q", "s")
