"""Column functions on text: tokens, sentences, ids, hashes, templates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.vectorised import vectorised

#: English stop words, a fixed list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
WORD = r"[\p{L}\p{N}]+"
BLANKS = " \t\n\x0b\f\r"
#: The DNS namespace of name-based UUIDs, a fixed value.
UUID_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def tokens(text: Column, keep_stop_words: bool = False) -> Column:
    """Lower-cased runs of letters and digits; without English stop words unless asked for."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    return found if keep_stop_words else F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def sentences(text: Column) -> Column:
    """Pieces that end in . ! or ?, without the white space between them."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+", -1), strip), lambda s: s != "")


def lines(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1), lambda s: strip(s) != "")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def question_hash(question: Column) -> Column:
    """md5 of a question's lower-cased letters, digits and blanks."""
    return F.md5(F.regexp_replace(strip(F.lower(question)), r"[^\p{L}\p{N}\s]", ""))


def overlap(left: Column, right: Column) -> Column:
    """The part of left's distinct items that right holds."""
    own = F.array_distinct(left)
    return share(F.size(F.array_intersect(own, right)), F.size(own))


def uuid5(name: Column) -> Column:
    """The name-based UUID in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE)), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def finite(vector: Column) -> Column:
    """The vector with 0 in place of what is not a finite number."""
    return F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))


def cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


@vectorised("string")
def compose(text: pd.Series) -> pd.Series:
    """NFKC, with line ends as spaces and the dashes U+2010 to U+2013 as hyphens."""
    dashes = {0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x0A: " "}
    return text.str.normalize("NFKC").str.translate(dashes)
