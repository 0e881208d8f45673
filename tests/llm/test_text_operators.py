"""Ops 2, 3, 4, 5, 6, 9 against brute force, known answers and held-out labels."""

import itertools
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridwise.llm import cotraining, decontamination, html_layout, queries, repetition, sieve, suffix_tree, tool_calls

from ..comparing import oracle, rows
from .fixtures import documents, frame, prose, words_of


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# Op 5.
def measured(t):
    w = words_of(t)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {x for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), again, len(hit)


def share(w, n):
    """Characters in n-grams that occur twice or more."""
    grams = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    hit = {x for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] > 1 for x in range(k, k + n)}
    return sum(len(w[x]) for x in hit) / max(1, sum(map(len, w)))


@pytest.mark.parametrize("whole", [False, True])
def test_repetition(spark, sf_dir, whole):
    if whole:
        docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
        got = queries.op5_repetition_coverage(spark, sf_dir).collect()
    else:
        docs = [(r[0], r[1]) for r in documents()] + [(900, "a b c d e f g h i j " * 3), (901, "x y z\n" * 9)]
        got = repetition.rules(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    key = lambda i: -1 if i is None else i
    by = defaultdict(list)
    for r in got:
        by[key(r["doc_id"])].append(r)
    assert len(got) == len(docs)
    for i, t in docs:
        e = measured(t)
        found = [r for r in by[key(i)] if (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e]
        assert found, (i, e)
        failed = e[0] < 10 or 100 * e[4] > 20 * e[0]
        assert found[0]["base_failed"] == failed and not (failed and found[0]["kept"])
        if e[0] < 400:
            assert found[0]["dup_7"] == pytest.approx(share(words_of(t), 7))
            assert found[0]["dup_10"] == pytest.approx(share(words_of(t), 10))


def test_repetition_of_nothing(spark):
    assert repetition.rules(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# Op 2.
def best_stretch(doc, item):
    """The most equal words in a stretch scored +1 and -4, over all ways to lay the item on the document."""
    best = 0
    for lay in range(-len(item), len(doc)):
        same = [doc[lay + k] == w for k, w in enumerate(item) if 0 <= lay + k < len(doc)]
        score, n, top, top_n = 0, 0, 0, 0
        for s in same:
            if score < 0:  # of equally good stretches the longest counts
                score, n = 0, 0
            score, n = score + (1 if s else -4), n + s
            if score > top:
                top, top_n = score, n
        best = max(best, top_n)
    return best


def most_equal(doc, item):
    """The most equal words over all ways to lay the whole item on the document."""
    return max((sum(0 <= lay + k < len(doc) and doc[lay + k] == w for k, w in enumerate(item)) for lay in range(-len(item), len(doc))), default=0)


def contaminated(doc, item):
    """Equal words of an item that contaminates a document, else None."""
    doc, item = words_of(lower(doc)), words_of(lower(item))
    least = math.ceil(0.8 * len(item) - 1e-9)
    if item and (n := best_stretch(doc, item)) >= min(13, least):
        return n
    return n if item and (n := most_equal(doc, item)) >= least else None


def test_decontamination(spark):
    r = random.Random(2)
    items = [(k, prose(r, n)) for k, n in enumerate((16, 30, 50, 9, 5))] + [(7, None), (8, ""), (9, prose(r, 3)), (11, "x")]
    items += [items[1], (20, items[1][1])]
    docs = []
    for k, (_, t) in enumerate(items[:3]):
        docs += [(10 * k, prose(r, 80) + " " + t + " " + prose(r, 30)), (10 * k + 1, prose(r, 20) + "\n" + t.upper())]
        w = t.split()
        w[6] = "other"
        docs.append((10 * k + 2, prose(r, 20) + " " + " ".join(w)))
        docs.append((10 * k + 3, prose(r, 40) + " " + " ".join(t.split()[:6])))
    docs += [(50, items[3][1]), (51, items[4][1]), (52, None), (53, ""), (None, items[1][1]), (54, prose(r, 3000)), (55, "X marks"), (56, items[7][1] + " x"), (57, items[7][1].split()[0])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x["n_matched"] for x in decontamination.overlaps(df, bench).collect()}
    expected = {(i, k): n for i, t in docs for k, item in dict(reversed(items)).items() if k != 20 and (n := contaminated(t, item)) is not None}
    assert got == expected and len(got) >= 14
    kept = decontamination.clean(df, bench)
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {x for x, _ in expected})
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.overlaps(df, none).count() == 0 and decontamination.clean(df, none).count() == len(docs)
    assert decontamination.overlaps(df.limit(0), bench).count() == 0 and decontamination.clean(df.limit(0), bench).count() == 0


def test_items_of_every_length_with_substitutions(spark):
    """All pairs of which four fifths are equal are found, from one word to fifty."""
    r = random.Random(21)
    items = {n: [f"v{n}x{k}" for k in range(n)] for n in range(1, 51)}
    docs = []
    for n, w in items.items():
        for m in range(4):
            for _ in range(4 if m else 1):
                p = set(r.sample(range(n), min(m, n)))
                docs.append((len(docs), " ".join(["before"] * 3 + ["other" if k in p else x for k, x in enumerate(w)] + ["after"] * 3)))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x["n_matched"] for x in decontamination.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    expected = {}
    for i, t in docs:
        n = int(re.search(r"v(\d+)x", t)[1]) if "v" in t else 0
        if n and (m := contaminated(t, " ".join(items[n]))) is not None:
            expected[i, n] = m
    assert got == expected


def test_equal_words_take_linear_time(spark):
    docs = [(1, "a " * 50_000), (2, "b " * 30 + "a " * 900), (3, "c")]
    items = [(1, "a " * 1000), (2, "a " * 500 + " ".join(f"z{k}" for k in range(500))), (3, "a " * 12 + " ".join(f"y{k}" for k in range(80)))]
    began = time.perf_counter()
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): x["n_matched"] for x in got} == {(1, 1): 1000, (1, 2): 500, (2, 1): 900, (2, 2): 500}
    assert time.perf_counter() - began < 60


def test_decontamination_of_upper_cased_accents(spark):
    item = "où êtes-vous allé dès l’été près de l’île où la forêt était brûlée à côté de la grande straße"
    df = spark.createDataFrame([(1, "one two three " + item.upper()), (2, item), (3, "ou etes vous")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, item), (6, "ÇA ÉTÉ À ÖL ÜBER ÄHRE ÎLE ÔTER ÛN")], "item_id bigint, text string")
    n = len(item.split())
    assert sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in decontamination.overlaps(df, bench).collect()) == [(1, 5, n), (2, 5, n)]
    assert [r["doc_id"] for r in decontamination.clean(df, bench).collect()] == [3]


def test_substitutions_anywhere_in_short_items(spark):
    r = random.Random(12)
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in (*range(8, 21), 25)}
    docs, expected = [], set()
    for n, words in items.items():
        most = n - math.ceil(0.8 * n)
        places = [p for m in (1, 2) for p in itertools.combinations(range(n), m)] + [tuple(sorted(r.sample(range(n), most))) for _ in range(30)] + [tuple(range(3, n, 4))[:most]]
        for p in places:
            changed = ["other" if k in p else w for k, w in enumerate(words)]
            docs.append((len(docs), " ".join(["before"] * 5 + changed + ["after"] * 5)))
            if len(p) <= most:
                expected.add((docs[-1][0], n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string")
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert expected <= {(x["doc_id"], x["item_id"]) for x in got}
    assert all(x["n_matched"] >= min(13, math.ceil(0.8 * x["item_words"])) for x in got)


def test_a_benchmark_that_fills_the_sieve(spark, monkeypatch):
    monkeypatch.setattr(sieve, "BITS", 64)
    monkeypatch.setattr(sieve.make, "__defaults__", (64,))
    r = random.Random(4)
    items = [(k, prose(r, 20)) for k in range(9)]
    df = spark.createDataFrame([(k, prose(r, 9) + " " + t) for k, t in items] + [(99, prose(r, 50))], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((x["doc_id"], x["item_id"]) for x in decontamination.overlaps(df, bench).collect()) == [(k, k) for k in range(9)]
    assert [x["doc_id"] for x in decontamination.clean(df, bench).collect()] == [99]


def test_decontamination_query(spark, sf_dir):
    bench = {r["item_id"]: words_of(lower(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: words_of(lower(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    whole = {(i, k) for i, d in docs.items() for k, w in bench.items() if " ".join(w) in " ".join(d)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_spaced_seed_decontamination(spark, sf_dir).collect()}
    assert whole <= got and len(got) <= 2 * len(whole) + 3


# Op 3.
def test_tool_calls_query_equals_its_sql(spark, sf_dir):
    ours = queries.op3_tool_call_linking(spark, sf_dir).toPandas()
    assert rows(ours) == rows(oracle(sf_dir, queries.TOOL_CALLS_SQL))


def test_structured_tool_calls(spark):
    def call(*calls):
        return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "needs": list(needs)} for i, n, a, needs in calls]})

    def result(i, content):
        return json.dumps({"tool_call_id": i, "content": content})

    turns = [
        (1, 0, "system", 'say "hi"\n'),
        (1, 1, "assistant", call(("a", "add", '{"y": 2, "x": 1.50}', ()), ("b", "add", '{"x": "1"}', ("a",)), ("c", "gone", "{}", ("b", "a")))),
        (1, 2, "tool", result("a", "3")), (1, 3, "tool", result("b", "é")), (1, 4, "tool", result("zz", "?")), (1, 5, "tool", result("a", "4")),
        (2, 1, "tool", result("k", "early")), (2, 2, "assistant", call(("k", "add", "[1]", ()), ("l", "add", '{"x":1,"y":2,"z":3}', ("m",)), ("m", "add", '{"x":1,"y":2}', ("l",)))),
        (3, 0, "user", "q"), (3, 1, "assistant", "r"), (3, 1, "assistant", "r"), (3, 3, "assistant", "late"), (4, 0, "user", None), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
    ]
    schemas = {"add": {"x": tool_calls.Field("number"), "y": tool_calls.Field("integer")}, "reply": tool_calls.SCHEMAS["reply"]}
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, status int")
    got = {(r["conv_id"], r["turn"], r["place"]): r for r in tool_calls.link(df, schemas).collect()}
    view = {k: (r["kind"], r["step"], r["status"], r["errors"]) for k, r in got.items()}
    assert view[1, 1, 0] == ("call", 0, "linked", "")
    assert view[1, 1, 1] == ("call", 2, "linked", "x: not of type number; y: missing")
    assert view[1, 1, 2] == ("call", 4, "unanswered", "unknown tool")
    assert view[1, 2, 0][:3] == ("result", 1, "linked") and view[1, 3, 0][:3] == ("result", 3, "linked")
    assert view[1, 4, 0][1:3] == (None, "orphan") and view[1, 5, 0][1:3] == (None, "duplicate")
    assert view[2, 1, 0][2] == "early" and view[2, 2, 0] == ("call", 0, "early", "not an object")
    assert view[2, 2, 1] == ("call", None, "blocked", "z: unknown") and view[2, 2, 2][2] == "blocked"
    assert view[3, 0, 0][:3] == ("call", 0, "linked") and got[3, 1, 0]["copies"] == 2 and view[3, 3, 0][2] == "orphan"
    assert view[4, 0, 0] == ("call", 0, "unanswered", "text: missing")
    assert view[None, 0, 0][2] == "unanswered" and view[None, 1, 0][2] == "orphan"
    assert got[1, 1, 0]["json"] == '{"arguments":{"x":1.5,"y":2},"call_id":"a","kind":"call","name":"add","step":0,"turn":1}'
    assert got[1, 0, 0]["json"] == '{"content":"say \\"hi\\"\\n","kind":"message","role":"system","turn":0}'
    for r in got.values():
        parsed = json.loads(r["json"])
        assert list(parsed) == sorted(parsed)
    assert tool_calls.link(df.limit(0), schemas).count() == 0


def test_tool_calls_with_ties_give_a_row_each(spark):
    """Turns of one number whose calls share id and arguments: one is first, nothing is multiplied."""
    def call(name, needs=()):
        return json.dumps({"tool_calls": [{"id": "a", "name": name, "arguments": "{}", "needs": list(needs)}]})

    turns = [(1, 1, "assistant", call("f")), (1, 1, "assistant", call("g")), (1, 1, "assistant", call("f", ("z",))), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "r"})), (1, 2, "tool", json.dumps({"content": "r", "tool_call_id": "a"}))]
    out = tool_calls.link(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), {}).collect()
    assert sorted((r["kind"], r["status"]) for r in out if r["status"] != "blocked") in ([("call", "duplicate")] * 2 + [("call", "linked"), ("result", "duplicate"), ("result", "linked")], [("call", "duplicate")] * 2 + [("result", "duplicate"), ("result", "linked")])
    assert len(out) == 5
    odd = spark.createDataFrame([(1, 1, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "f", "arguments": "not {json"}]}))], "conv_id bigint, turn bigint, role string, text string")
    assert '"arguments":"not {json"' in tool_calls.link(odd, {}).first()["json"]


def test_long_chains_of_tool_calls(spark):
    calls = [(1, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(12)] + [(2, "x", ["y"]), (2, "y", ["x"])]
    got = {r["call_id"]: r["level"] for r in tool_calls.steps(spark.createDataFrame(calls, "conv_id bigint, call_id string, needs array<string>")).collect()}
    assert got == {f"c{k}": k for k in range(12)}


def test_tool_calls_are_native(spark, sf_dir):
    plan = queries.op3_tool_call_linking(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Op 4.
HTML = [
    ("<p>One<p>Two <b>bold<i>x</b> y</i><div>d<span> e </span></div>", "One\n\nTwo boldx y\n\nd e"),
    ("<ul><li>a<li>b<ul><li>c<li>d</ul><li>e</ul>after", "- a\n- b\n  - c\n  - d\n- e\n\nafter"),
    ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>wide cell that is long<tr><td>x<td>1234567</table>tail", "Name       Qty\napple pie  3\nwide cell that is long\nx          1234567\n\ntail"),
    ("<table><tr><td rowspan=2>A</td><td>b1</td></tr><tr><td>b2<br>b3</td></tr></table>", "A  b1\n   b2\n   b3"),
    ("<pre>  a\n   b\n</pre>x<textarea>t\n u</textarea>", "  a\n   b\n\nx\nt\n u"),
    ("<div hidden>no</div><p style='display: none'>no<p>yes<span style='visibility:hidden'>no<b style='visibility: visible'>too</b></span>", "yestoo"),
    ("a < b && c <!-- x --> f &lt;tag&gt; &copy &#65;", "a < b && c f <tag> © A"),
    ("<head><title>t</title></head><script>if (a<b) '</p>'</script>vis<style>p{}</style><noscript>n</noscript>", "vis"),
    ("<td>loose</td> <a href='x>y'>lnk</a> <a href=\"x", 'loose lnk <a href="x'),
    ("<table>foster<tr><td>c<table><tr><td>n1<td>n2</table><td>d</table>", "foster\nc       d\n\nn1  n2"),
    ("", ""), ("plain\n\n text", "plain text"), (None, None),
]


def test_html_layouts(spark):
    df = spark.createDataFrame([(k, h, "x") for k, (h, _) in enumerate(HTML)] + [(None, "z", "x")], "page_id bigint, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_layout.extract(df).collect()}
    assert [got[k] for k in range(len(HTML))] == [t for _, t in HTML] and got[None] == "z"
    assert html_layout.extract(df.limit(0)).count() == 0


def test_html_keeps_all_words_and_takes_linear_time(spark, sf_dir):
    for deep in ("<div>" * 20000 + "x", "<li>" * 5000 + "x", "<table><tr><td>" * 500 + "x", '<a "' * 9000, "<p><table><tr><td>" + "<div>" * 9000 + "x"):
        assert "x" in html_layout.render(deep) or deep.startswith("<a")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html

    for r in queries.op4_html_layout(spark, sf_dir).collect():
        body = re.sub(r"(?s)<(head|script|style)\b.*?</\1>|<!--.*?-->", " ", pages[r["page_id"]])
        assert re.sub(r"\s", "", r["text"]).replace("-", "") == re.sub(r"\s", "", html.unescape(re.sub(r"<[a-zA-Z/!][^<>]*>", "", body))).replace("-", "")


# Op 6.
def modelled(docs):
    """The same tree from plain counters."""
    tokens = [words_of(lower(t)) + [None] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    depth = suffix_tree.DEPTH
    c = {k: Counter() for k in range(1, depth + 2)}
    for w, h in zip(tokens, held, strict=True):
        for k in () if h else c:
            c[k].update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    n, v = sum(c[1].values()), len(c[1])
    least_context, least_next = suffix_tree.least_counts(n)
    listed, div = Counter(), Counter()
    for k in range(2, depth + 2):
        for g, m in c[k].items():
            if m >= least_next and c[k - 1][g[:-1]] >= least_context:
                listed[g[:-1]] += m
                div[g[:-1]] += m * (math.log(m / c[k - 1][g[:-1]]) - math.log(c[k - 1][g[1:]] / (c[k - 2][g[1:-1]] if k > 2 else n)))
    kept = {x for x in listed if div[x] >= suffix_tree.MIN_DIVERGENCE * c[len(x)][x]}
    out = []
    for w, h in zip(tokens, held, strict=True):
        a = b = 0.0
        for j, x in enumerate(w):
            p = (c[1][x,] + 1) / (n + v + 1)
            b += math.log10(p)
            for k in range(1, depth + 1):
                s = tuple(w[j - k : j]) if j >= k else None
                if s in kept:
                    m = c[k + 1][*s, x]
                    p = ((m if m >= least_next else 0) + (c[k][s] - listed[s] + suffix_tree.MU) * p) / (c[k][s] + suffix_tree.MU)
            a += math.log10(p)
        out.append((h, len(w), sum(c[1][x,] > 0 for x in w), n, b, a))
    return out, len(kept)


@pytest.mark.parametrize("whole", [False, True])
def test_suffix_tree(spark, sf_dir, whole):
    if whole:
        docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
        got = queries.op6_suffix_tree_scoring(spark, sf_dir).collect()
    else:
        docs = [(r[0], r[1]) for r in documents()]
        docs += [(1000 + k, "the license says that all of the text may be used by all of us") for k in range(60)]
        got = suffix_tree.score(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    expected, kept = modelled(docs)
    view = lambda r: (str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6))
    assert sorted(map(view, got)) == sorted(view((i, *e)) for (i, _), e in zip(docs, expected, strict=True))
    assert kept > 10
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_suffix_tree_of_nothing(spark):
    assert suffix_tree.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = suffix_tree.score(spark.createDataFrame([(2, "A a"), (None, None)], "doc_id bigint, text string")).collect()
    assert sorted(r["n_tokens"] for r in one) == [1, 3]


def test_suffix_tree_has_the_same_least_counts_at_any_size():
    row = {"first": np.array([0, 1]).tobytes(), "codes": np.zeros(1, np.int32).tobytes(), "words": np.array([suffix_tree.END]).tobytes(), "held": np.zeros(1, bool).tobytes(), "told": None}
    for n in (0, 16_000_000, 81_000_000, 5_000_000_000):
        block = suffix_tree.Block(row, n)
        assert (block.min_context, block.min_next) == suffix_tree.least_counts(n) == (suffix_tree.MIN_CONTEXT, suffix_tree.MIN_NEXT)


# Op 9.
def junk(r):
    return " | ".join("".join(r.choice("abc") for _ in range(5)) for _ in range(60)) + " ###"


def test_cotraining_on_held_out_labels(spark):
    r = random.Random(8)
    good = [(k, prose(r, r.randint(30, 200)), "en", f"src{k % 3}", 100, "a", k) for k in range(300)]
    bad = [(1000 + k, junk(r), "en", f"src{3 + k % 2}", 50, "a", k) for k in range(100)]
    extra = [(None, prose(r, 50), None, None, None, None, None), (5000, None, "en", "src0", 0, "a", 1), (5001, "", "en", "new", None, "a", 1), good[0], (5002, prose(r, 9000), "en", "src1", 1, "a", 1)]
    docs = frame(spark, good + bad + extra)
    rows_ = [(k, 1) for k in range(0, 300, 2)] + [(1000 + k, 0) for k in range(0, 100, 2)] + [(None, 1), (7777, 0), (4, None), (2, 1)]
    labels = spark.createDataFrame(rows_, "doc_id bigint, quality int")
    got = {x["doc_id"]: x for x in cotraining.classify(docs, labels).collect()}
    held = [(k, True) for k in range(1, 300, 2)] + [(1000 + k, False) for k in range(1, 100, 2)]
    assert sum(got[k]["kept"] == y for k, y in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values()) and len(got) == 300 + 100 + 4
    kept = cotraining.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {k for k, x in got.items() if x["kept"]}


def test_cotraining_without_labels_keeps_all(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert cotraining.keep(docs, labels).count() == docs.count()
    assert cotraining.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_cotraining_learns_from_all_unlabelled_documents(spark):
    r = random.Random(9)
    docs = [(k, prose(r, 12) if k % 2 else junk(r)[:90], "en", "common" if k < 4400 else "rare", 80, "a", k) for k in range(4500)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, quality int")
    # The source "last" is that of the documents which a sample of 4,000 would leave out.
    sampled = {x["doc_id"] for x in cotraining._some(spark.range(200, 4500).withColumnRenamed("id", "doc_id"), 4000, 2).collect()}
    docs = [(*x[:3], "last", *x[4:]) if x[0] >= 200 and x[0] not in sampled else x for x in docs]
    model = cotraining.fit(frame(spark, docs), labels)
    assert model.pages.values["source"] == ["common", "last", "rare"]


def test_cotraining_rejects_toxic_documents(spark):
    r = random.Random(10)
    rows_ = []
    for k in range(600):
        t = prose(r, r.randint(30, 120))
        if k % 5 == 0:
            words = t.split(" ")
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["Vilest", "vermin", "wretch"])
            t = " ".join(words)
        rows_.append((k, t, "en", f"src{k % 3}", len(t), "a", k))
    rows_ += [(k, junk(r), "en", "src1", 50, "a", k) for k in range(600, 750)] + [(None, None, None, None, None, None, None), (900, "", "en", "x", 0, "a", 1)]
    docs = frame(spark, rows_)
    known = [(k, int(k < 600), int(k < 600 and k % 5 == 0)) for k in range(750) if k % 2] + [(3, None, None), (None, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x for x in cotraining.classify(docs, labels).collect()}
    toxic = [got[k] for k in range(0, 600, 10)]
    clean = [got[k] for k in range(0, 600, 2) if k % 5]
    assert sum(not x["kept"] for x in toxic) / len(toxic) > 0.9
    assert sum(x["kept"] for x in clean) / len(clean) > 0.97
    assert all(x["kept"] == (x["score"] >= 0.5 and x["toxic_score"] < 0.5) for x in got.values())
    assert {x["doc_id"] for x in cotraining.keep(docs, labels).collect()} == {k for k, x in got.items() if x["kept"]}
    # Without the second column of labels nothing counts as toxic.
    assert all(x["toxic_score"] == 0 for x in cotraining.classify(docs, labels.drop("toxic")).collect())


def test_cotraining_fits_the_same_threshold_on_a_sample_of_labels(spark):
    r = random.Random(11)
    docs = frame(spark, [(k, prose(r, 20) if k % 10 else junk(r), "en", "s", 9, "a", k) for k in range(1000)])
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(1000)], "doc_id bigint, quality int")
    every, some = ({x["doc_id"]: x["kept"] for x in cotraining.classify(docs, labels, labelled=n).collect()} for n in (4000, 160))
    assert sum(every[k] == some[k] for k in every) / len(every) > 0.98


def test_cotraining_query_on_held_out_toxic_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = cotraining.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("doc_id % 4 > 0")).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    toxic, clean = ([x["kept"] for x in got if x["toxic"] == t and x["quality"] == 1] for t in (1, 0))
    assert sum(toxic) / len(toxic) < 0.3
    assert sum(clean) / len(clean) > 0.97


def test_cotraining_query_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    half = spark.createDataFrame([(k, v) for k, v in labels.items() if k % 2], "doc_id bigint, quality int")
    got = cotraining.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), half).collect()
    right = [r["kept"] == bool(labels[r["doc_id"]]) for r in got if r["doc_id"] in labels and r["doc_id"] % 2 == 0]
    assert sum(right) / len(right) > 0.93


def test_suffix_tree_sends_contexts_by_rank():
    ids = (np.uint64(3) << np.uint64(32)) + np.array([2, 5, 700], np.uint64)
    sent = suffix_tree._send(8, 1, ids, np.zeros(3), np.zeros(3), 2).to_pylist()
    assert [x["part"] for x in sent] == [3 + (2 << 8)]
    assert suffix_tree.unranked(sent[0]["keys"]).tolist() == [2, 5, 700]
    assert len(sent[0]["keys"]) == 12  # 24 as hashes


def test_suffix_tree_sends_n_grams_by_part_and_rank():
    rng = np.random.default_rng(1)
    bits, width = 8, 11
    number = lambda most: (rng.integers(0, 1 << bits, 200_000).astype(np.uint64) << np.uint64(32)) + rng.integers(0, most, 200_000).astype(np.uint64)
    before, word = number(900), number(1500)
    keys, code = np.unique(suffix_tree._joined(before, word, bits, width), return_inverse=True)
    assert len(keys) == len(set(zip(before.tolist(), word.tolist(), strict=True)))
    assert all(np.unique(x[np.argsort(code)][np.flatnonzero(np.diff(np.sort(code), prepend=-1))][code] == x) for x in (before, word))
    sent = suffix_tree._send(bits, 1, keys, np.ones(len(keys)), None, level=2).to_pylist()
    read = [suffix_tree.unstepped(x["keys"]) + np.uint64(x["part"] << (64 - bits)) for x in sent]
    assert np.array_equal(np.concatenate(read), keys)
    assert sum(len(x["keys"]) for x in sent) < 3.1 * len(keys)  # 8 as hashes
    with pytest.raises(OverflowError):
        suffix_tree._joined(np.array([1 << 31], np.uint64), word[:1], bits, 30)


def test_suffix_tree_keeps_no_hash_of_a_counted_word(spark):
    before = {x.name for x in spark.catalog.listTables()}
    docs = [(k, f"the license says that all of the text may be used word{k % 30}") for k in range(60)]
    assert suffix_tree.score(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).count() == 60
    kept = {x.name for x in spark.catalog.listTables()} - before
    assert len(kept) == suffix_tree.DEPTH + 2  # the blocks, and the answers after those about words
    assert not any("words" in spark.table(x).columns for x in kept)
    for r in next(spark.table(x) for x in kept if "blocks" in x).collect():
        codes = suffix_tree.unplanes(r["codes"])
        assert len(np.unique(codes)) == codes.max() + 1  # all last bytes first, which compresses better
    told = [y for x in kept if "level2" in x for r in spark.table(x).collect() for y in r["told"]]
    counts = np.concatenate([suffix_tree.unplanes(y["counts"]) for y in told])
    assert len(counts) and not ((counts > 0) & (counts < suffix_tree.MIN_NEXT)).any()  # such counts change nothing
