"""Canonical texts and tokens of field records, as Column expressions that stay in the JVM."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

BLANKS = " \t\n\x0b\x0c\r"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The value as a string, null as the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.btrim(text(c), F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" "))


def no_tokens() -> Column:
    return F.array().cast("array<string>")


def tokens_of(words: str) -> Column:
    return constant(words.split(), "array<string>")


def constant(value, schema: str) -> Column:
    """A literal of any type. It is one JSON string until the optimizer folds it, which keeps large tables cheap to plan."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def lookup(table: dict[str, str], key: Column) -> Column:
    """The words of table[key] as an array, empty if there is none."""
    return F.coalesce(F.element_at(constant({k: w.split() for k, w in table.items()}, "map<string, array<string>>"), key), no_tokens())


def lookup_word(table: dict[str, str], key: Column) -> Column:
    """table[key], null if there is none."""
    return F.element_at(constant(table, "map<string, string>"), key)


def hashed(tokens: Column) -> Column:
    """A token set as 64-bit hashes: sets of longs are compared in generated code, sets of strings are not."""
    return F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))


def when_tokens(condition: Column, *tokens: Column | str) -> Column:
    """The tokens if the condition holds, else none."""
    return F.when(condition, F.array(*[F.lit(t) if isinstance(t, str) else t for t in tokens])).otherwise(no_tokens())


# --- serialisation --------------------------------------------------------------------------------------------------
def split_identifier(c: Column | str) -> Column:
    """Camel-case boundaries and underscores become spaces; case stays."""
    parts = F.regexp_replace(strip(c), "([a-z0-9])([A-Z])", "$1 $2")
    return squeeze(F.replace(parts, F.lit("_"), F.lit(" ")))


def path_text(c: Column | str) -> Column:
    """The dotted path with each part split; a path of dots alone is left as it is."""
    p = strip(c)
    parts = F.filter(F.split(p, r"\."), lambda x: x != "")
    shown = F.filter(F.transform(parts, split_identifier), lambda x: x != "")
    return F.when(F.size(parts) == 0, p).otherwise(F.array_join(shown, " . "))


def substitute_placeholders(c: Column | str, time_first: bool = False) -> Column:
    """Addresses, ports and times become [IP], :[PORT], [TIME].

    Ports are replaced before times, so a time has lost its colons when its turn comes; time_first mends that.
    """
    steps = [(V.IP_PATTERN, "[IP]"), (V.PORT_PATTERN, ":[PORT]"), (V.TIME_PATTERN, "[TIME]")]
    if time_first:
        steps = [steps[2], *steps[:2]]
    return reduce(lambda out, step: F.regexp_replace(out, step[0], step[1]), steps, text(c))


def tagged(tag: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"[{tag}] "), value))


def serialize(
    mode: str = "nmo",
    mask_name: bool = False,
    drop_type: bool = False,
    drop_path: bool = False,
    drop_desc: bool = False,
    drop_example: bool = False,
    no_placeholder: bool = False,
    name: Column | str = "name",
    type: Column | str = "type",
    path: Column | str = "path",
    desc: Column | str = "desc",
    example: Column | str = "example",
    raw_msg: Column | str = "raw_msg",
) -> Column:
    """The text of a field record: `nmo` tags name, type and path; `context` joins all values; `raw_msg` is the message.

    `msg` is another name of raw_msg; an unknown mode is nmo. Empty parts are left out with their tags.
    """
    if mode in ("raw_msg", "msg"):
        return strip(raw_msg)
    empty = F.lit("")
    name_ = empty if mask_name else split_identifier(name)
    type_ = empty if drop_type else strip(type)
    path_ = empty if drop_path else path_text(path)
    if mode != "context":
        return F.concat_ws(" ", tagged("NAME", name_), tagged("TYPE", type_), tagged("PATH", path_))
    hide = strip if no_placeholder else lambda c: substitute_placeholders(strip(c))
    desc_ = empty if drop_desc else hide(desc)
    example_ = empty if drop_example else hide(example)
    return F.concat_ws(" ", *[F.nullif(x, empty) for x in (name_, type_, path_, desc_, example_)])


def component(c: Column | str, tag: str) -> Column:
    """What follows the first [TAG], up to the next bracket."""
    return strip(F.regexp_extract(text(c), rf"\[{tag.upper()}\]([^\[]*)", 1))


def tagged_component(c: Column | str, tag: str) -> Column:
    """What follows the first [TAG], up to the next tag of capitals or the end of the line; other brackets are content."""
    return strip(F.regexp_extract(text(c), rf"\[{tag}\]\s*(.*?)(?=\s*\[[A-Z]+\]|$)", 1))


# --- normalisation and tokens ---------------------------------------------------------------------------------------
def normalize(c: Column | str) -> Column:
    """Lower-case words of an identifier: boundaries of case and digits split, punctuation to spaces, Korean to English."""
    # fixed values
    steps = [
        (r"([a-z])([A-Z])", "$1 $2"),
        (r"([A-Za-z])(\d)", "$1 $2"),
        (r"(\d)([A-Za-z])", "$1 $2"),
        (r"`", " "),
        (r"[\[\]\(\)\{\},:;/\\|]+", " "),
        (r"[\._$\-]+", " "),
    ]
    out = reduce(lambda x, step: F.regexp_replace(x, step[0], step[1]), steps, text(c))
    # texts without Hangul skip the dictionary
    pairs = constant([{"ko": w, "en": f" {V.KOREAN[w]} "} for w in sorted(V.KOREAN, key=len, reverse=True)], "array<struct<ko: string, en: string>>")
    english = F.aggregate(pairs, out, lambda acc, x: F.replace(acc, x["ko"], x["en"]))
    return F.lower(squeeze(F.when(out.rlike("[가-힣]"), english).otherwise(out)))


def plain_tokens(c: Column | str) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda x: x != "")


def grams(token: Column, n: int) -> Column:
    """All runs of n characters of a token that has at least n."""
    return F.when(F.length(token) >= n, F.transform(F.sequence(F.lit(1), F.length(token) - (n - 1)), lambda i: F.substr(token, i, F.lit(n)))).otherwise(no_tokens())


def plain_between(token: Column, low: int, high: int) -> Column:
    """Has the token low to high characters, all of a-z and 0-9?"""
    return token.rlike(rf"\A[a-z0-9]{{{low},{high}}}\z")


def expand(token: Column) -> Column:
    """A token with all that it stands for, in order."""
    known = F.coalesce(F.array_contains(tokens_of(" ".join(V.TOKEN_ALIAS)), token), F.lit(False))
    parts = [F.array(token), lookup(V.TOKEN_ALIAS, token)]
    for s in V.SUFFIXES:
        cut = F.substr(token, F.lit(1), F.length(token) - len(s))
        parts.append(when_tokens(~known & token.endswith(s) & (F.length(token) > len(s) + 1), cut, s))
    rest = F.substr(token, F.lit(4))
    # fixed values
    for prefix, words in (("src", ["source"]), ("dst", ["destination"]), ("sip", ["source", "ip"]), ("dip", ["destination", "ip"])):
        parts.append(when_tokens(token.startswith(prefix) & (token != prefix), *words, rest))
    parts.append(when_tokens(token.startswith("nat"), "nat"))
    parts.append(F.when(token.startswith("nat") & (rest != ""), F.concat(F.array(rest), lookup(V.TOKEN_ALIAS, rest))).otherwise(no_tokens()))
    parts += [lookup(V.SYNONYMS, token), lookup(V.SHORT_FORMS, token)]
    parts.append(F.when(plain_between(token, 4, 20), F.concat(grams(token, 3), grams(token, 4))).otherwise(no_tokens()))
    return F.concat(*parts)


def rich_tokens(c: Column | str) -> Column:
    """The ordered tokens of an identifier with aliases, splits, short forms and 3- and 4-character runs."""
    return F.flatten(F.transform(plain_tokens(c), expand))


def tokens(c: Column | str, strong: bool = True) -> Column:
    return rich_tokens(c) if strong else plain_tokens(c)


def bm25_tokens(c: Column | str) -> Column:
    """Rich tokens and the 3- to 5-character runs of the whole text without spaces."""
    compact = F.replace(normalize(c), F.lit(" "), F.lit(""))
    return F.concat(rich_tokens(c), F.when(plain_between(compact, 4, 64), F.concat(*[grams(compact, n) for n in (3, 4, 5)])).otherwise(no_tokens()))


def sparse_text(name: Column | str = "name", type: Column | str = "type", path: Column | str = "path") -> Column:
    """What sparse matchers index: name, path and type, weighted by repetition, with their rich tokens."""
    dotless = F.replace(text(path), F.lit("."), F.lit(" "))
    parts = [normalize(name), normalize(name), F.array_join(rich_tokens(name), " "), normalize(dotless), F.array_join(rich_tokens(dotless), " "), normalize(type), normalize(type)]
    return F.btrim(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(" "))


def rule_expand(token: Column) -> Column:
    rest3, rest4 = F.substr(token, F.lit(4)), F.substr(token, F.lit(5))
    return F.concat(
        F.array(token),
        lookup(V.COMPACT_SPLITS, token),
        when_tokens(token.startswith("src") & (token != "src"), "source", rest3),
        when_tokens(token.startswith("dst") & (token != "dst"), "destination", rest3),
        when_tokens(token.startswith("dest") & (token != "dest"), "destination", rest4),
        when_tokens(token.startswith("sport") & (token != "sport"), "source", "port"),
        when_tokens(token.startswith("dport") & (token != "dport"), "destination", "port"),
    )


def rule_tokens(c: Column | str) -> Column:
    """The set of tokens that rules compare."""
    return F.array_distinct(F.filter(F.flatten(F.transform(F.filter(rich_tokens(c), lambda x: x != ""), rule_expand)), lambda x: x != ""))


def compact_norm(c: Column | str) -> Column:
    """All rich tokens joined without spaces."""
    return F.array_join(rich_tokens(c), "")


def simple_name(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def simple_path_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text(c)), r"[_\./\-]+", " "), r"\s+"), lambda x: x != ""))


def path_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), r"[\./_\$\[\]:]+"), lambda x: x != ""))


def type_base(c: Column | str) -> Column:
    """The type in lower case; a JSON object gives its `base`."""
    raw = text(c)
    base = F.when(F.btrim(raw, F.lit(BLANKS)).startswith("{"), F.coalesce(F.get_json_object(raw, "$.base"), F.lit(""))).otherwise(raw)
    return F.lower(F.btrim(base, F.lit(BLANKS)))


def canonical_type(c: Column | str) -> Column:
    """The group of the type, or the type of letters and digits alone if it is in none."""
    plain = F.regexp_replace(type_base(c), "[^a-z0-9]+", "")
    return F.coalesce(lookup_word({w: group for group, words in V.TYPE_GROUPS.items() for w in words.split()}, plain), plain)


def slots(c: Column | str, tokens: Column) -> Column:
    """The kinds of value that the text shows by pattern, or its tokens by word."""
    found = [F.when(text(c).rlike(p), F.lit(s)) for s, p in V.SLOT_PATTERNS.items()]
    found += [F.when(F.arrays_overlap(tokens, tokens_of(words)), F.lit(s)) for s, words in V.SLOT_WORDS.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


# --- drift ----------------------------------------------------------------------------------------------------------
def drift_path(c: Column | str) -> Column:
    """Each part of a dotted path becomes slot0, slot1 and so on."""
    parts = F.filter(F.split(text(c), r"\."), lambda x: x != "")
    return F.when(F.size(parts) == 0, text(c)).otherwise(F.array_join(F.transform(parts, lambda _, i: F.concat(F.lit("slot"), i.cast("string"))), "."))


def drift_type(c: Column | str) -> Column:
    t = F.lower(strip(c))
    return F.when(t == "", "").otherwise(F.coalesce(lookup_word(V.TYPE_DRIFT, t), F.lit("string")))


def drift_tagged(c: Column | str, tag: str, drift) -> Column:
    """Drift the value after [TAG] in a serialised text; the space before the next tag goes with it."""
    value = F.regexp_extract(text(c), rf"\[{tag}\]\s+([^\[]+)", 1)
    new = F.concat(F.regexp_extract(text(c), rf"(?s)^(.*?\[{tag}\]\s+)[^\[]+", 1), drift(F.btrim(value, F.lit(BLANKS))), F.regexp_extract(text(c), rf"(?s)^.*?\[{tag}\]\s+[^\[]+(.*)$", 1))
    return F.when(value == "", text(c)).otherwise(new)
