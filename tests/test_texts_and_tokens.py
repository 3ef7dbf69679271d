"""Canonical texts, tokens and similarities against plain-Python versions."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import similarity as S
from fieldloom.functions import text as X
from fieldloom.functions import vocabulary as V

NAMES = ["srcIp", "dst_port", "sourceip", "sessionId", "natsport", "natPool", "proto", "msg", "client", "usr", "username", "eventTime", "src", "srcip2", "Address", "출발지주소", "서비스명", "a", "", "IPv4Addr", "x[0].y-z$w", "filePath", "destHost", "macaddr", "module_name", "12ab34", "policyid", "`tick`", "dportRange", "user"]


def rows(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [tuple(r) for r in df.select(*columns).collect()]


def normalize(s):
    for p, r in ((r"([a-z])([A-Z])", r"\1 \2"), (r"([A-Za-z])(\d)", r"\1 \2"), (r"(\d)([A-Za-z])", r"\1 \2")):
        s = re.sub(p, r, s)
    s = re.sub(r"[`\[\]\(\)\{\},:;/\\|._$\-]", " ", s)
    for k in sorted(V.KOREAN, key=len, reverse=True):
        s = s.replace(k, f" {V.KOREAN[k]} ")
    return " ".join(s.split()).lower()


def grams(t, n):
    return [t[i : i + n] for i in range(len(t) - n + 1)]


def rich(s):
    out = []
    for t in normalize(s).split():
        out += [t, *V.TOKEN_ALIAS.get(t, "").split()]
        if t not in V.TOKEN_ALIAS:
            out += [x for suffix in V.SUFFIXES if t.endswith(suffix) and len(t) > len(suffix) + 1 for x in (t[: -len(suffix)], suffix)]
        for p, add in (("src", ["source"]), ("dst", ["destination"]), ("sip", ["source", "ip"]), ("dip", ["destination", "ip"])):
            if t.startswith(p) and t != p:
                out += [*add, t[3:]]
        if t.startswith("nat"):
            out += ["nat", *([t[3:], *V.TOKEN_ALIAS.get(t[3:], "").split()] if t[3:] else [])]
        out += [*V.SYNONYMS.get(t, "").split(), *V.SHORT_FORMS.get(t, "").split()]
        if re.fullmatch("[a-z0-9]{4,20}", t):
            out += grams(t, 3) + grams(t, 4)
    return out


def test_normalize_and_tokens(spark):
    got = rows(spark, NAMES, X.normalize("v"), X.rich_tokens("v"), X.bm25_tokens("v"), X.plain_tokens("v"), X.compact_norm("v"))
    for name, (norm, tokens, bm25, plain, compact) in zip(NAMES, got):
        assert norm == normalize(name)
        assert tokens == rich(name)
        assert plain == norm.split()
        assert compact == "".join(tokens)
        joined = norm.replace(" ", "")
        more = [g for n in (3, 4, 5) for g in grams(joined, n)] if re.fullmatch("[a-z0-9]{4,64}", joined) else []
        assert bm25 == tokens + more


def test_known_tokens(spark):
    by = dict(zip(NAMES, rows(spark, NAMES, X.rich_tokens("v"), X.rule_tokens("v"))))
    assert by["src"][0] == ["src", "source", "ip"]
    assert by["user"][0][:2] == ["user", "usr"]
    assert {"mac", "address"} <= set(by["macaddr"][1])
    assert len(by["srcIp"][1]) == len(set(by["srcIp"][1]))


def test_serialisation(spark):
    df = spark.createDataFrame([("Source IP", "string", "event.src.ip", "seen 10.0.0.1:80", None, " raw "), ("userName_x", None, "...", "", "at 2024-01-01 12:34:56", None), (None, "", None, None, None, None)], "name string, type string, path string, desc string, example string, raw_msg string")
    nmo, context, raw, masked, dropped = zip(*df.select(X.serialize(), X.serialize("context"), X.serialize("msg"), X.serialize(mask_name=True), X.serialize("context", drop_desc=True, no_placeholder=True)).collect())
    assert nmo == ("[NAME] Source IP [TYPE] string [PATH] event . src . ip", "[NAME] user Name x [PATH] ...", "")
    # ports go before times, so a time keeps its date and hour only
    assert context == ("Source IP string event . src . ip seen [IP]:[PORT]", "user Name x ... at 2024-01-01 12:[PORT]:[PORT]", "")
    assert raw == ("raw", "", "")
    assert masked[0] == "[TYPE] string [PATH] event . src . ip"
    assert dropped[1] == "user Name x ... at 2024-01-01 12:34:56"
    assert rows(spark, ["2024-01-01 12:34:56"], X.substitute_placeholders("v", time_first=True)) == [("[TIME]",)]


def test_components_and_drift(spark):
    t = "[NAME] a [x] b [TYPE] ip [PATH] event . src"
    assert rows(spark, [t], X.component("v", "name"), X.tagged_component("v", "NAME"), X.component("v", "desc")) == [("a", "a [x] b", "")]
    assert rows(spark, [t], X.drift_tagged("v", "TYPE", X.drift_type)) == [("[NAME] a [x] b [TYPE] string[PATH] event . src",)]
    assert rows(spark, [t], X.drift_tagged("v", "PATH", X.drift_path)) == [("[NAME] a [x] b [TYPE] ip [PATH] slot0.slot1",)]
    assert rows(spark, ["a..b", "", "..", None], X.drift_path("v")) == [("slot0.slot1",), ("",), ("..",), ("",)]
    assert rows(spark, ["IP ", "uuid", ""], X.drift_type("v")) == [("string",), ("string",), ("",)]


def test_types(spark):
    got = rows(spark, ['{"base": " IPv4 "}', "Var-Char", "uuid", None], X.type_base("v"), X.canonical_type("v"))
    assert got == [("ipv4", "ip"), ("var-char", "string"), ("uuid", "uuid"), ("", "")]
    df = spark.createDataFrame([("integer", "port"), ("port", "integer"), ("float", "float"), ("boolean", "boolean"), ("x", "y")], "a string, b string")
    assert [tuple(r) for r in df.select(S.type_compat_a("a", "b"), S.type_compat_b("a", "b"), S.exact_type("a", "b")).collect()] == [(0.6, 0.8, 0.0), (0.6, 0.8, 0.0), (0.0, 1.0, 1.0), (0.0, 1.0, 1.0), (0.0, 0.0, 0.0)]


def test_set_similarities(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"]), (["source", "x"], ["target", "x"])], "a array<string>, b array<string>")
    got = [tuple(r) for r in df.select(S.jaccard(F.col("a"), F.col("b")), S.overlap(F.col("a"), F.col("b")), S.polarity_penalty(F.col("a"), F.col("b")), S.polarity_bonus(F.col("a"), F.col("b")), S.end_bonus(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.25, 0.5, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0), (pytest.approx(1 / 3), 0.5, 1.0, 0.0, 0.3)]


def test_name_ratio(spark):
    pairs = [("srcip", "sourceip"), ("", "a"), ("abc", "abc"), ("출발지", "출발")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(S.name_ratio("a", "b")).collect()] == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    assert rows(spark, ["Src_IP-1", "출발_지"], S.bare_name("v")) == [("srcip1",), ("출발지",)]


def test_slots(spark):
    got = rows(spark, ["from 10.1.2.3 at 2024-01-02 to a@b.com", "see https://x.org/y", "plain words", "aa:bb:cc:dd:ee:ff"], X.slots("v", F.split("v", " ")))
    assert {"IP", "TIME", "EMAIL", "DOMAIN", "PORT"} <= set(got[0][0])
    assert "URL" in got[1][0] and got[2][0] == [] and "MAC" in got[3][0]
