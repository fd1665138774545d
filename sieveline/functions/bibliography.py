"""Expressions over bibliographic records: inverted abstracts, identifiers, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of_index(index: Column) -> Column:
    """The text of a JSON object of words and their places. Negative and missing places are left out; of two words at one
    place the first in order stays; null or broken JSON gives null."""
    at = lambda e: F.transform(F.filter(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: p >= 0), lambda p: F.struct(p.alias("place"), e["key"].alias("word")))
    placed = F.array_sort(F.flatten(F.transform(F.map_entries(F.from_json(index, "map<string,array<int>>")), at)))
    # A lambda variable holds the sorted places, so that they aren't made again for each element.
    first = lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["place"] != x["place"]))
    words = F.transform(F.array(placed), lambda all_: F.array_join(F.transform(first(all_), lambda x: x["word"]), " "))
    return F.get(words, F.lit(0))


def last_part(url: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(url, "/", -1)


def reference_ids(urls: Column) -> Column:
    """Distinct ids of references, in order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(urls, last_part), lambda x: x.isNotNull() & (x != "")))


def registry_numbers(text: Column) -> Column:
    """Distinct trial numbers in a text, upper case, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(r"NCT\d{8}"), 0)))
