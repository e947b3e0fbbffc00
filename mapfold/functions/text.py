"""Text clean-up, parsing and classification as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(s: Column) -> Column:
    """Lower case, punctuation to spaces (TXT1)."""
    return F.regexp_replace(F.lower(s), r"(?U)[^\w\s]", " ")


def tidy(s: Column) -> Column:
    """Lower case, dashes and runs of white space to one space (TXT2)."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(s), "-", " "), r"\s+", " "))


def replace_synonyms(s: Column, pairs: dict[str, str]) -> Column:
    """Each key replaced by its value, in order (TXT3)."""
    for old, new in pairs.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def is_line_feature(s: Column, prefixes: tuple[str, ...]) -> Column:
    """Rule by prefix (TXT4)."""
    out = F.lit(False)
    for p in prefixes:
        out = out | s.startswith(p)
    return out


def point_class(s: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first class one of whose keywords is in s (TXT4)."""
    out = None
    for label, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | s.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def title_case(s: Column) -> Column:
    """TXT6."""
    return F.initcap(F.lower(s))


def search_string(name: Column, counties: Column, state: Column) -> Column:
    """Name, counties and state of a gazetteer row; nulls are skipped (TXT7)."""
    return F.concat_ws(" ", name, F.replace(counties, F.lit(","), F.lit(" ")), state)


def sheet_name(url: Column) -> Column:
    """Last path part without .pdf (TXT15)."""
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".pdf"), F.lit(""))


def rejoin_pieces(tokens: Column) -> Column:
    """Word pieces with ## joined to their word (TXT20)."""
    return F.replace(F.array_join(tokens, " "), F.lit(" ##"), F.lit(""))


def answer_rows(answer: Column) -> Column:
    """[(symbol, description)] in a model's answer, null where it is no such list (TXT21). Never evaluated as code."""
    inner = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    as_json = F.regexp_replace(F.translate(F.translate(inner, "()", "[]"), "'", '"'), r",\s*\]", "]")
    return F.try_element_at(F.array(F.from_json(as_json, "array<array<string>>")), F.lit(1))


def same_transcription(a: Column, b: Column, specials: str = r"""[!?.:,*"()·\[\]/']""") -> Column:
    """Equal in upper case, one special character at either edge of the first set aside (TXT22)."""
    a, b = F.upper(a), F.upper(b)
    head, tail = F.regexp_replace(a, f"^{specials}", ""), F.regexp_replace(a, f"{specials}$", "")
    both = F.regexp_replace(head, f"{specials}$", "")
    return (a == b) | (head == b) | (tail == b) | (both == b)


def file_parts(path: Column, n_last: int) -> tuple[Column, Column]:
    """A file name's stem split at _: (all but the last n joined, the last n) (TXT24)."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    keep = F.greatest(F.size(parts) - n_last, F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), keep), "_"), F.slice(parts, keep + 1, F.lit(n_last))


def without_hyphens(s: Column) -> Column:
    """TXT25; of a whole file, so signs go too."""
    return F.replace(s, F.lit("-"), F.lit(""))


def ascii_only(s: Column, instead: str = " ") -> Column:
    """FLT14."""
    return F.regexp_replace(s, r"[^\x00-\x7F]+", instead)


def in_dictionary(s: Column, least: int = 3) -> Column:
    """Letters only once edge specials are gone, and long enough (FLT16)."""
    word = F.regexp_replace(F.regexp_replace(s, r"'[sS]$", ""), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return (F.length(word) >= least) & word.rlike(r"^[A-Za-zÀ-ÖØ-öø-ſ-]+$")


def catalog_id(s: Column) -> Column:
    """Quotes stripped, dots dropped (SRC5)."""
    return F.replace(F.btrim(s, F.lit("'")), F.lit("."), F.lit(""))


def listed(s: Column, schema: str = "array<string>") -> Column:
    """A list written in a cell with single quotes (SRC6)."""
    return F.from_json(F.translate(s, "'", '"'), schema)


def token_sorted(s: Column) -> Column:
    """Lower-cased tokens in order, once more one string."""
    return F.array_join(F.array_sort(F.filter(F.split(plain(s), r"\s+"), lambda t: t != "")), " ")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    return 1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))
