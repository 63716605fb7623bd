import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from bondwise.llm import disclosure
from bondwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def spans_by_hand(text):
    """The patterns of the contract as they stand."""
    find = lambda kind, p: [(kind, m.start(), m.end(), m.group()) for m in re.finditer(p, text)]
    out = find("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    out += [s for s in find("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in s[3].split("."))]
    out += [s for s in find("card", r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(s[3])) <= 19 and luhn(digits(s[3]))]
    return out + [s for s in find("phone", r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(s[3])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+1 2(5)é%", max_size=40) | st.text(alphabet="a.@-", max_size=25) | st.text(alphabet="4 -1.", max_size=30))
def test_base_spans_are_those_of_the_patterns(text):
    got = [(disclosure.KINDS[k], s, e) for k, s, e, _ in disclosure.base_spans(text)]
    assert got == [s[:3] for s in spans_by_hand(text)]


def lower(w):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in w)


def classes(w):
    return [(0, lower(w))] + [(p, lower(w)[:p]) for p in disclosure.PREFIXES]


def by_hand(texts, window, support, disclosed):
    """The spans of every text, by enumeration of all texts, entities and words."""
    texts = [t or "" for t in texts]
    df, met, own, met_texts, near_of, words_of = Counter(), Counter(), Counter(), defaultdict(set), [], []
    for t in texts:
        base = spans_by_hand(t)
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(t)]
        words_of.append((base, words))
        df.update({c for *_, w in words for c in classes(w)})
        near = defaultdict(set)
        for kind, s, e, v in base:
            entity = (kind, v.lower() if kind == "email" else v if kind == "ip" else digits(v))
            around = [w for w in words if w[1] <= s][-window:] + [w for w in words if w[0] >= e][:window]
            near[entity] |= {c for a, b, w in around if all(b <= x or a >= y for _, x, y, _ in base) for c in classes(w)}
        near_of.append(near)
        for entity, cs in near.items():
            own[entity] += 1
            met_texts[entity].add(t)
            for c in cs:
                met[entity, c] += 1
                met_texts[entity, c].add(t)
    n, out = len(texts), []
    bad = {
        (e, c) for (e, c), k in met.items()
        if len(met_texts[e, c]) >= support and own[e] < n and math.log2(n * k / (df[c] * own[e])) >= disclosed * math.log2(n / own[e]) - 1e-9
    }
    for near, (base, words) in zip(near_of, words_of):
        flagged, extra = {c for e, cs in near.items() for c in cs if (e, c) in bad}, []
        for s, e, w in words:
            if (0, lower(w)) in flagged and all(e <= x or s >= y for _, x, y, _ in base):
                kept = next((p for p in disclosure.PREFIXES if p < len(w) and (p, lower(w)[:p]) not in flagged), 0)
                extra.append(("generalised" if kept else "removed", s, e))
        out.append(",".join(f"{k}:{s}:{e}" for k, s, e, *_ in base + sorted(extra)))
    return out


def corpus():
    rng = random.Random(4)
    common = ["the", "of", "town", "people", "said", "week", "über", "Éte", "paper", "papers", "general", "generous"]
    entities = ["ann.lee@mail.example.com", "+1 (555) 010-2233", "10.20.30.40", "4111 1111 1111 1111"]
    marks = [["zorgle", "clubhouse"], ["generalist", "papership"], ["Quxman"], ["generation"]]
    texts = []
    for k in range(120):
        words = [rng.choice(common) for _ in range(30)]
        if k % 6 == 0:
            which = (k // 6) % 4
            words[12:12] = [marks[which][0], entities[which], *marks[which][1:]]
        texts.append(" ".join(words) + "." * (k % 3))
    return texts + [texts[6]] * 5 + [None, "", "zorgle alone in a clean document", "generalist " * 3]


def test_terms_match_enumeration(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, base string, n_email int")
    got = {r["doc_id"]: r for r in disclosure.report(docs).collect()}
    want = by_hand(texts, disclosure.WINDOW, disclosure.SUPPORT, disclosure.DISCLOSED)
    assert [got[k]["spans"] for k in range(len(texts))] == want
    kinds = Counter(s.split(":")[0] for w in want for s in w.split(",") if s)
    assert min(kinds[k] for k in ("email", "phone", "ip", "card", "removed", "generalised")) > 0
    # clean documents stay clean, though they hold a disclosing term
    assert want[-2] == want[-1] == ""


def test_sanitised_texts_keep_rows_and_columns(spark):
    texts = corpus()
    schema = "text string, base string, key int, `odd name` string, row long"
    docs = spark.createDataFrame([(t, "mine", 7, "o", k) for k, t in enumerate(texts)], schema)
    got = disclosure.sanitise(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    rows = {r["row"]: r for r in got.collect()}
    assert len(rows) == len(texts) and {(r["base"], r["key"], r["odd name"]) for r in rows.values()} == {("mine", 7, "o")}
    for k, t in enumerate(texts):
        if t is None or not spans_by_hand(t):
            assert rows[k]["text"] == t
        else:
            assert not spans_by_hand(rows[k]["text"]) and "zorgle" not in rows[k]["text"]


def test_query_gives_base_spans_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {r["doc_id"]: r for r in QUERIES["op13_disclosure"](spark, SF).collect()}
    want = by_hand(list(docs["text"]), disclosure.WINDOW, disclosure.SUPPORT, disclosure.DISCLOSED)
    assert len(got) == len(docs)
    for doc_id, text, spans in zip(docs["doc_id"], docs["text"], want):
        base = [s[:3] for s in spans_by_hand(text or "")]
        r = got[doc_id]
        assert [r[f"n_{k}"] for k in disclosure.KINDS] == [sum(s[0] == k for s in base) for k in disclosure.KINDS]
        assert r["base_sha256"] == hashlib.sha256(disclosure.joined(base).encode()).hexdigest() and r["spans"] == spans


def test_empty_tables_and_very_long_texts(spark):
    schema = "doc_id long, text string"
    assert disclosure.report(spark.createDataFrame([], schema)).collect() == []
    long = ["a" * 1_500_000 + "@", "1" * 1_000_000, "1." * 400_000, "+1" * 400_000, "4 " * 600_000, "é" * 1_200_000 + " x@y.zz " + "w" * 1_300_000, "+1((((" * 100_000]
    rows = {r["doc_id"]: r for r in disclosure.report(spark.createDataFrame(list(enumerate(long)), schema)).collect()}
    assert len(rows) == len(long) and rows[5]["n_email"] == 1 and rows[2]["n_ip"] == 100_000 and rows[0]["n_email"] == 0
