"""Text expressions: normalising, fences, versions, labels, templates, escaping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from echoscore import constants as K

# White space as Unicode defines it plus the four ASCII separators, as a list for
# trimming and as a class for patterns, and the punctuation code points that are newer than the
# JVM's Unicode tables.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NEW_PUNCTUATION = (
    r"\x{61d}\x{1b7d}-\x{1b7e}\x{2e53}-\x{2e5d}\x{10f86}-\x{10f89}\x{116b9}"
    r"\x{11b00}-\x{11b09}\x{11f43}-\x{11f4f}\x{12ff1}-\x{12ff2}"
)
# The same classes behind one cheap range test each, which most letters fail: twice as fast.
SPACE_RUN = rf"[[\x09-\x20\x{{80}}-\x{{3000}}]&&{SPACE}]{{2,}}"
PUNCTUATION = rf"[\p{{P}}[[^\x{{0}}-\x{{61c}}]&&[{NEW_PUNCTUATION}]]]+"


def strip(c: Column) -> Column:
    """Remove white space (any kind, not only blanks) at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_spaces(c: Column) -> Column:
    """Turn every run of two or more white-space characters into one blank."""
    return F.regexp_replace(c, SPACE_RUN, " ")


def remove_punctuation(c: Column) -> Column:
    """Delete punctuation; nothing takes its place, so '10-60' becomes '1060'."""
    return F.regexp_replace(c, PUNCTUATION, "")


def normalize(c: Column) -> Column:
    """Lower case, single blanks, no punctuation, no outer white space. NULL counts as ''."""
    return strip(remove_punctuation(collapse_spaces(F.lower(F.coalesce(c, F.lit(""))))))


def words(c: Column, word_sep: str = " ") -> Column:
    """Non-empty words of an already normalised text."""
    parts = F.split(strip(collapse_spaces(c)), rf"\Q{word_sep}\E")
    return F.filter(parts, lambda w: w != "")


def remove_end_mark(c: Column) -> Column:
    """Drop every end-of-transcript mark, then strip."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit(K.END_MARK), F.lit("")))


def strip_fence(c: Column) -> Column:
    """Remove one opening code fence (with or without the json tag) and one closing fence."""
    opened = F.regexp_replace(strip(c), r"\A```(?:json)?", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def _last_match(c: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def extract_prompt(c: Column) -> Column:
    """The proposed prompt in a free-text answer.

    In order of preference: the last prompt/text/markdown/untagged block; the last block of the
    proposal section; the whole proposal section; the whole answer.
    """
    section = F.regexp_substr(c, F.lit(K.PROPOSAL_SECTION))
    section_body = F.regexp_extract(section, K.PROPOSAL_SECTION, 1)
    return strip(
        F.coalesce(
            _last_match(c, K.FENCED_BLOCK), _last_match(section_body, K.ANY_FENCED_BLOCK), section_body, c
        )
    )


def version_number(c: Column) -> Column:
    """First 'v<digits>' as a number, 0 when there is none."""
    return F.coalesce(F.regexp_extract(c, K.VERSION_NUMBER, 1).try_cast("int"), F.lit(0))


def version_label(c: Column) -> Column:
    """Prompt file name without '.txt'; 'default' when missing or empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", K.DEFAULT_LABEL).otherwise(
        F.replace(c, F.lit(".txt"), F.lit(""))
    )


def number_or_zero(c: Column) -> Column:
    """A metric read from text; whatever is not a number counts as 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def number_or_null(c: Column) -> Column:
    """A metric read from text; not-a-number in every form becomes NULL, so it sorts last."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace placeholders one after the other, in the mapping's order.

    Sequential on purpose: a later placeholder is also replaced inside an earlier value. Other
    braces in the template stay as they are.
    """
    for placeholder, value in values.items():
        template = F.replace(template, F.lit(placeholder), F.coalesce(value, F.lit("")))
    return template


def url_quote(c: Column) -> Column:
    """Percent-encode a path, keeping '/' and '~'."""
    form = F.url_encode(c)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def url_unquote(c: Column) -> Column:
    """Undo percent-encoding. A raw '+' and a '%' that starts no escape stay as they are."""
    safe = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def html_escape(c: Column) -> Column:
    """Escape &, < and >, ampersand first."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def drop_extension(c: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(c, r"(?<=[^/])\.[^./]*\z", "")


def first_filled(*columns: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def absolute_path(c: Column, base: str) -> Column:
    return F.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat_ws("/", F.lit(base.rstrip("/")), c))


def result_path(path: Column, prompt_version: Column) -> Column:
    """Put the prompt version at the end of a result path exactly once.

    Any older version suffix, and whatever followed it, goes first. Paths that are not .csv and
    jobs without a version keep their path.
    """
    tail = F.concat(F.lit("_"), F.replace(prompt_version, F.lit(".txt"), F.lit("")))
    stem = F.regexp_replace(path, K.RESULT_SUFFIX, "")
    moved = F.concat(F.when(F.endswith(stem, tail), stem).otherwise(F.concat(stem, tail)), F.lit(".csv"))
    usable = (F.coalesce(prompt_version, F.lit("")) != "") & F.endswith(path, F.lit(".csv"))
    return F.when(usable, moved).otherwise(path)


def percent(c: Column) -> Column:
    """0.1234 -> '12.34%'."""
    return F.format_string("%.2f%%", c * 100)
