"""String and array functions as pure column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from tessella.session import text_slices

# The stop words of the knowledge tokenizer.
STOP_WORDS = (
    "a an the this that these those is are was were be been being have has had having do does did doing "
    "will would could should shall may might can must i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their theirs themselves "
    "in on at to for of with by from as into through during before after above below between under again further then once "
    "and but or nor not so if than about up out off over only own same too very just also now here there "
    "when where why how what which who whom all each every both few more most other some such any while"
).split()
# The stop words of query terms.
TERM_STOP_WORDS = (
    "a an and are as at be been by did do does for from had has have how in into is it its not of on or that the their this to "
    "under was were what when where which who why with"
).split()
# Patterns of query terms and identifiers.
TERM = r"[A-Za-z0-9][A-Za-z0-9_.:/@-]{0,127}"
IDENTIFIER = r"^(?=.{4,128}$)(?=.*[0-9_.:/@-])[A-Za-z0-9_.:/@-]+$"
MOST_TERMS = 64
#: Zero-width characters that scanners strip.
ZERO_WIDTH = "[​-‏‪-‮⁠-⁤﻿]"


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space, line breaks too, at either end."""
    return F.regexp_replace(_text(c), r"^\s+|\s+$", "")


def tokenize(c: Column | str) -> Column:
    """Lower-case tokens of letters, digits and hyphens, of two characters or more, without stop words; underscores are hyphens."""
    # Tokens are extracted: a replacement for every blank between them takes many times as long.
    found = F.regexp_extract_all(F.replace(F.lower(_text(c)), F.lit("_"), F.lit("-")), F.lit("[a-z0-9-]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def token_text(c: Column | str) -> Column:
    """The text with single blanks where tokens end; split it at blanks and keep what is_token keeps."""
    return F.regexp_replace(F.translate(F.lower(_text(c)), "_", "-"), "[^a-z0-9-]", " ")


def is_token(t: Column) -> Column:
    return (F.length(t) > 1) & ~t.isin(STOP_WORDS)


def expand_title(tokens: Column) -> Column:
    """The distinct tokens and, of those with hyphens, the parts of two characters or more."""
    parts = F.flatten(F.transform(tokens, lambda t: F.split(t, "-")))
    return F.array_distinct(F.concat(tokens, F.filter(parts, lambda p: F.length(p) > 1)))


def query_terms(c: Column | str) -> Column:
    """Distinct lower-case terms in order of first appearance, without stop words, 64 at most."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit(TERM), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~t.isin(TERM_STOP_WORDS))), 1, MOST_TERMS)


def match_expression(terms: Column) -> Column:
    """Quoted terms joined by OR; null if there are none."""
    quoted = F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(terms) > 0, F.array_join(quoted, " OR "))


def identifiers(c: Column | str) -> Column:
    """Distinct terms of 4 to 128 characters that have a digit or a mark, in order, 64 at most."""
    found = F.regexp_extract_all(_text(c), F.lit(TERM), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: t.rlike(IDENTIFIER))), 1, MOST_TERMS)


def snippet(content: Column, terms: Column, around: int = 200) -> Column:
    """The text from `around` characters before the first place of any term to as many after it; the first 400 if none appears."""

    def cut(at: Column) -> Column:
        start, end = F.greatest(F.lit(0), at - around), F.least(F.length(content), at + around)
        hit = F.concat(F.when(start > 0, "...").otherwise(""), strip(F.substring(content, start + 1, end - start)), F.when(end < F.length(content), "...").otherwise(""))
        head = strip(F.substring(content, 1, 2 * around))
        miss = F.concat(head, F.when(F.length(head) < F.length(content), "...").otherwise(""))
        return F.when(at >= 0, hit).otherwise(miss)

    first = lambda low: F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0)) - 1
    return bound(bound(F.lower(content), first), cut)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_name(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(_text(c))), r"[\s-]+", "-")


def slug(c: Column | str) -> Column:
    """Slug of a heading: word characters, blanks and hyphens stay, blanks become hyphens."""
    kept = F.regexp_replace(F.lower(strip(_text(c))), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-")


def slug_plain(c: Column | str) -> Column:
    """Slug of an id: runs of anything but letters and digits become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def token_estimate(c: Column | str) -> Column:
    return F.ceil(F.length(_text(c)) / 4).cast("long")


def args_summary(c: Column | str, most: int = 120) -> Column:
    """White space collapsed, cut with an ellipsis beyond `most` characters."""
    flat = strip(F.regexp_replace(_text(c), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def args_hash(c: Column | str, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), _text(c)), 256), 1, 8)


def cache_key(args: Column, volatile: tuple[str, ...] = ("force",)) -> Column:
    """Canonical JSON of a map of arguments: sorted keys, without volatile ones."""
    kept = F.map_filter(args, lambda k, _: ~k.isin(list(volatile)))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def string_or_list(c: Column | str) -> Column:
    """Trimmed non-empty members of a comma-separated text."""
    return F.filter(F.transform(F.split(_text(c), ","), lambda x: strip(x)), lambda x: x != "")


def overlap_tail(c: Column | str, most: int) -> Column:
    """The last `most` characters, from after the first line break, or else blank, in their first half."""
    tail = F.when(F.length(_text(c)) > most, F.substring(_text(c), -most, most)).otherwise(_text(c))
    at = lambda mark: F.position(F.lit(mark), tail) - 1
    early = lambda mark: (at(mark) >= 0) & (at(mark) < F.floor(F.length(tail) / 2))
    after = lambda mark: F.substring(tail, at(mark) + 2, F.length(tail))
    return strip(F.when(early("\n"), after("\n")).when(early(" "), after(" ")).otherwise(tail))


def byte_offset(content: Column, char_offset: Column) -> Column:
    """UTF-8 bytes before a character offset."""
    return F.octet_length(F.substring(content, F.lit(1), char_offset.cast("int"))).cast("long")


def span_verified(content: Column, byte_start: Column, byte_end: Column, span_sha256: Column) -> Column:
    """Whether the bytes of a span still hash to what was recorded."""
    piece = F.substring(content.cast("binary"), (byte_start + 1).cast("int"), (byte_end - byte_start).cast("int"))
    return F.sha2(piece, 256) == span_sha256


def de_dot(path: Column | str) -> Column:
    """A path whose segments have lost a leading dot."""
    return F.array_join(F.transform(F.split(_text(path), "/"), lambda s: F.regexp_replace(s, r"^\.", "")), "/")


def status_of_line(line: Column | str) -> Column:
    """done, active or pending of a milestone's line: its checkbox, else a marker, else pending."""
    c = _text(line)
    # Checkbox marks and words of each state, in order.
    tests = (
        ("done", r"\[[xX]\]"),
        ("active", r"\[[/~\-]\]"),
        ("pending", r"\[ \]"),
        ("done", r"✅|\b(SHIPPED|DONE|COMPLETE|LIVE)\b"),
        ("active", r"🚧|(?i:\b(WIP|IN[\s-]?PROGRESS)\b)"),
    )
    out = F
    for state, pattern in tests:
        out = out.when(c.rlike(pattern), state)
    return out.otherwise("pending")


def status_rank(status: Column) -> Column:
    return F.when(status == "done", 2).when(status == "active", 1).when(status == "pending", 0)


def backtick_id(c: Column | str) -> Column:
    """M3, M3b or SP2 from the first slug in backticks that names a milestone or spike; null without one."""
    slugs = F.regexp_extract_all(_text(c), F.lit("`([a-z0-9][a-z0-9-]*)`"), F.lit(1))
    spike = lambda s: F.regexp_extract(s, r"-spike-(\d+)(?:-|$)", 1)
    stone = lambda s: F.regexp_extract(s, r"-m(\d+[a-z]?)(?:-|$)", 1)
    named = F.transform(slugs, lambda s: F.when(spike(s) != "", F.concat(F.lit("SP"), spike(s))).when(stone(s) != "", F.concat(F.lit("M"), stone(s))))
    return F.get(F.array_compact(named), F.lit(0))


# Where a subject's planning metadata begins.
TITLE_ENDS = (
    r"\s+—\s+(?:milestone|spike)\s+ID\b",
    r"\s+—\s+(?:Must|Should|Could|Won't)\b",
    r"\s+Milestone\s+ID\b",
    r"\s+Spike\s+ID\b",
    r"\s+Verdict\b",
    r"\s+RESOLVED\s+\d{4}-\d{2}-\d{2}\b",
    r"\s+Outcome\s*:",
    r"\s+Output\s*:",
    r"\s+Decision\s+doc\s*→",
    r"\s+Blocks\b",
    r"\s+RICE\s*(?:\(|=|:)",
)


def semantic_title(c: Column | str) -> Column:
    """A subject without its planning metadata; the subject itself if nothing is left, untitled if that is empty."""
    subject = strip(_text(c))
    title = F.regexp_replace(F.regexp_replace(subject, r"(?i)^←\s*E\d+\s*:\s*", ""), r"(?i)^\(CLOSED[^)]*\)\s*:\s*", "")
    title = F.regexp_replace(title, "(?is)(?:" + "|".join(TITLE_ENDS) + ").*$", "")
    title = F.regexp_replace(title, "^[ :—\\-·.]+|[ :—\\-·.]+$", "")
    return F.when(title != "", title).when(subject != "", subject).otherwise("untitled")


def normalise_tags(tags: Column, add: str | None = None) -> Column:
    """Distinct trimmed lower-case tags in order, with one added."""
    clean = F.filter(F.transform(tags, lambda t: F.lower(strip(t))), lambda t: t != "")
    return F.array_distinct(F.concat(clean, F.array(F.lit(add))) if add else clean)


def normalised(texts: pa.Array) -> pa.Array:
    """NFKC of each text, a few MB at a time; a part that has nothing to change is handed on as it is."""
    done = []
    for part in text_slices(pa.record_batch([texts], ["t"]), 0):
        rows = part.column(0).to_pylist()
        same = all(x is None or x.isascii() or unicodedata.is_normalized("NFKC", x) for x in rows)
        done.append(part.column(0) if same else pa.array([x if x is None else unicodedata.normalize("NFKC", x) for x in rows], texts.type))
    return texts if not done else done[0] if len(done) == 1 else pa.concat_arrays(done)


@F.arrow_udf(T.StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFKC, which Spark has no function for, a batch at a time."""
    for texts in batches:
        yield normalised(texts)


def scan_text(c: Column | str) -> Column:
    """Text as safety rules see it: NFKC, no zero-width characters, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(nfkc(_text(c)), ZERO_WIDTH, ""), r"\s+", " "))


def safe_query(c: Column | str) -> Column:
    """The normalised query, null unless it has 1 to 1000 characters and no NUL."""
    q = strip(nfkc(_text(c)))
    return F.when(F.length(q).between(1, 1000) & ~F.contains(q, F.lit("\x00")), q)
