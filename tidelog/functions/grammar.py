"""The command language: set and delete, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(command: Column) -> Column:
    """A struct (kind, k, v). Tokens are split at white space; the verb is in any case; kind is set, delete, noop for a blank command, or error for an unknown verb or a wrong number of tokens. Errors never fail a job."""
    t = F.filter(F.split(command, r"\s+"), lambda x: x != "")
    n, verb = F.size(t), F.lower(F.try_element_at(t, F.lit(1)))
    kind = F.when(n == 0, "noop").when((verb == "set") & (n == 3), "set").when((verb == "delete") & (n == 2), "delete").otherwise("error")
    good = kind.isin("set", "delete")
    return F.struct(kind.alias("kind"), F.when(good, F.try_element_at(t, F.lit(2))).alias("k"), F.when(kind == "set", F.try_element_at(t, F.lit(3))).alias("v"))


def format_set(k: Column, v: Column) -> Column:
    """The text of a set command."""
    return F.concat_ws(" ", F.lit("SET"), k, v)
