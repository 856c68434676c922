"""Unicode forms, which have no built-in function: vectorised UDFs over Arrow batches."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import collapsed


def _each(s: pd.Series, f) -> pd.Series:
    known = {v: f(v) for v in s.dropna().unique()}
    return s.map(known)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return _each(s, lambda v: unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Decomposed, then without what isn't ASCII."""
    return _each(s, lambda v: unicodedata.normalize("NFD", v).encode("ascii", "ignore").decode("ascii"))


@F.pandas_udf(StringType())
def nfkd_unmarked(s: pd.Series) -> pd.Series:
    return _each(s, lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not "̀" <= c <= "ͯ"))


@F.pandas_udf(StringType())
def uuid5_url(s: pd.Series) -> pd.Series:
    return _each(s, lambda v: str(uuid.uuid5(uuid.NAMESPACE_URL, v)))


def match_key(name):
    """The key that extracted names are matched by: no accents, one space, lower case."""
    return F.lower(collapsed(F.when(name.rlike(r"^[\x00-\x7F]*$"), name).otherwise(ascii_fold(name))))


def slug_folded(name):
    slug = F.regexp_replace(F.lower(nfkd_unmarked(name)), "[^a-z0-9]+", "_")
    return F.regexp_replace(slug, "^_+|_+$", "")


def graph_person_id(person_id, name, birth_year):
    made = F.concat(slug_folded(name), F.lit("_"), F.coalesce(birth_year.cast("string"), F.lit("unknown")))
    return F.coalesce(F.nullif(person_id, F.lit("")), made)
