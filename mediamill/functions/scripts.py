"""Another script by a dictionary of phrases, longest first."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Entries and characters of a dictionary, at most: it is broadcast.
ENTRIES, CHARACTERS = 1 << 20, 1 << 25


class Trie:
    """Phrases by their letters, in nested tables."""

    def __init__(self, entries: dict[str, str]) -> None:
        self.root: dict = {}
        for phrase, to in entries.items():
            at = self.root
            for letter in phrase:
                at = at.setdefault(letter, {})
            at[""] = to

    def convert(self, text: str) -> str:
        """From the left the longest phrase at each place gives way; letters of none stay."""
        out, k, root = [], 0, self.root
        while k < len(text):
            at, end, to = root, k, None
            for j in range(k, len(text)):
                if (at := at.get(text[j])) is None:
                    break
                if "" in at:
                    end, to = j + 1, at[""]
            out.append(text[k] if to is None else to)
            k = max(end, k + 1)
        return "".join(out)


def converter(dictionary: DataFrame, phrase: str = "phrase", to: str = "to") -> Callable[[Column | str], Column]:
    """A function from text columns to text columns, by the phrases of a table.

    The table's size is checked before it is broadcast; a dictionary of more than ENTRIES phrases or CHARACTERS letters is
    refused, as it must fit every worker. Of several rows for a phrase the least counts; null or empty phrases and null results
    drop out. Null text stays null.
    """
    rows = dictionary.select(F.col(phrase).alias("phrase"), F.col(to).alias("to")).where("phrase <> '' and to is not null").groupBy("phrase").agg(F.min("to").alias("to"))
    count, letters = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase") + F.length("to")), F.lit(0))).first()
    if count > ENTRIES or letters > CHARACTERS:
        raise ValueError(f"a dictionary of {count} phrases and {letters} letters is too large to broadcast")
    shared = dictionary.sparkSession.sparkContext.broadcast({r.phrase: r.to for r in rows.collect()})
    made: list[Trie] = []

    @F.pandas_udf("string")
    def convert(text: pd.Series) -> pd.Series:
        if not made:
            made.append(Trie(shared.value))
        return text.map(made[0].convert, na_action="ignore")

    return convert.asNondeterministic()
