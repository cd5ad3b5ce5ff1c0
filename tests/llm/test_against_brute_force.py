import math
import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessarine.llm import ann, common, fingerprints, html_density, language_id, near_dedup, packing, piece_viterbi, queries, secret_scan, sharding, url_rules

# 1: guess cost


def span_costs(scorer, value, a, b):
    piece = value[a:b]
    out = [float(len(piece)) * secret_scan.PER_CHAR]
    word = scorer.word_cost(piece)
    if word is not None:
        out.append(word)
    out += [c for x, y, c in scorer.dates(value) if (x, y) == (a, b)]
    for unit in range(1, min(secret_scan.MAX_UNIT, len(piece) // 2) + 1):
        if len(piece) % unit == 0 and piece == piece[:unit] * (len(piece) // unit):
            out.append(brute_cost(scorer, piece[:unit]) + len(str(len(piece) // unit)))
    places = [secret_scan._PLACE.get(secret_scan._SHIFTED.get(c, c)) for c in piece]
    if len(piece) >= 3 and None not in places:
        steps = [(q[0] - p[0], q[1] - p[1]) for p, q in zip(places, places[1:])]
        if all(s in secret_scan._STEPS for s in steps):
            out.append(secret_scan.WALK_START + secret_scan.WALK_TURN + sum(secret_scan.WALK_ON if s == t else secret_scan.WALK_TURN for s, t in zip(steps, steps[1:])))
    return min(out)


def brute_cost(scorer, value):
    best = [0.0] + [math.inf] * len(value)
    for b in range(1, len(value) + 1):
        best[b] = min(best[a] + (secret_scan.BREAK if a else 0.0) + span_costs(scorer, value, a, b) for a in range(b))
    return best[-1]


SCORER = secret_scan.GuessCost(secret_scan.load_words(None))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["password", "Dragon", "qwe", "asdf", "1", "2024", "12-31-1999", "20240131", "ab", "ababab", "zzzz", "p4ss", "X", "7", "#", "hunter2"]), min_size=1, max_size=4).map("".join))
def test_guess_cost_is_the_minimum(value):
    cost, parts = SCORER.parts(value)
    assert cost == pytest.approx(brute_cost(SCORER, value))
    assert [parts[0][1], *[p[2] for p in parts]] == [0, *[p[1] for p in parts[1:]], len(value)]


def test_secrets_and_harmless_values(spark):
    texts = ["password=password123", "api_key: 'f3A9x0Qm7Zk2LwPd81sV'", "token = qwertyuiop", "the token was lost", "secret: 2024-01-31", "pwd=abcabcabcabcabcabc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in secret_scan.scan(df).where("is_secret").collect()} == {1}
    long = secret_scan.GuessCost(secret_scan.load_words(None)).parts("xy" * 5000)
    assert long[0] < 8 and [k for k, _, _ in long[1]] == ["repeat"]


def test_credential_contexts(spark):
    """Each form passes the filter of the JVM and the finder, and its value alone is masked."""
    value = "f3A9x0Qm7Zk2LwPd81sV"
    forms = ['SECRET_KEY = "%s"', "secret_key: %s", "encryption_key=%s", "DB_PASS=%s", "api key: %s", "Authorization: Bearer %s", "<password>%s</password>", '<db:password type="plain"> %s </db:password>', 'password =     "%s"', "token_id: '%s'", "secretKey=%s", "cfg['password'] = '%s'", "password=%s", '"api_key": "%s"']
    df = spark.createDataFrame([(i, f % value) for i, f in enumerate(forms)] + [(99, f"the compass: {value}")], "doc_id long, text string")
    assert {r["doc_id"] for r in secret_scan.scan(df).where("is_secret").collect()} == set(range(len(forms)))
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert masked == {i: f % "[SECRET]" for i, f in enumerate(forms)} | {99: f"the compass: {value}"}


def test_short_random_values_are_secrets_by_default(spark):
    values = ["k7#Qz!9w", "R4v$x8Lp2", "password", "password123", "qwertyuiop", "2024-01-31", "aaaaaaaaaa", "trustno1"]
    df = spark.createDataFrame([(i, f"password = '{v}'") for i, v in enumerate(values)], "doc_id long, text string")
    assert {r["doc_id"] for r in secret_scan.scan(df).where("is_secret").collect()} == {0, 1}
    assert {r["doc_id"] for r in secret_scan.redact(df).where("text like '%[SECRET]%'").collect()} == {0, 1}


@pytest.mark.parametrize("space", ["\u00a0", "\u2003", "\u3000", "\x85", "\x1f", "\t "])
def test_white_space_is_the_same_on_both_sides(spark, space):
    """What the JVM's filter passes and what Python finds agree: alone, and beside another context."""
    texts = [f"password{space}= Xk9$mQ2vLp7!tRz", f"password{space}= Xk9$mQ2vLp7!tRz and token = abc1", "pa\u017fsword = Xk9$mQ2vLp7!tRz", "pa\u017fsword = Xk9$mQ2vLp7!tRz and token = abc1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in secret_scan.scan(df).where("is_secret").collect()} == {0, 1}
    assert [r["text"] for r in secret_scan.redact(df).orderBy("doc_id").collect()] == [t if "\u017f" in t else t.replace("Xk9$mQ2vLp7!tRz", "[SECRET]") for t in texts]


def test_lengths_change_only_where_a_mask_is_put(spark):
    df = spark.createDataFrame([(1, "the [SECRET] of x = y", -5), (2, "password = Xk9$mQ2vLp7!tRz", -5), (3, None, -5)], "doc_id long, text string, n_chars int")
    assert [r["n_chars"] for r in secret_scan.redact(df).orderBy("doc_id").collect()] == [-5, len("password = [SECRET]"), -5]


def test_kinds_of_equal_cost():
    """One letter of rank 10 costs as much as brute force: the word, which is earlier in the list, is told."""
    scorer = secret_scan.GuessCost({f"w{i}xyz": i for i in range(1, 10)} | {"q": 10})
    assert scorer.parts("q") == (1.0, [("word", 0, 1)]) and scorer.parts("#") == (1.0, [("brute", 0, 1)])


# 2: fingerprints


def slow_boundaries(data, minimum, normal, maximum):
    bits = normal.bit_length() - 1
    ends, at = [], 0
    while len(data) - at > minimum:
        end = min(at + maximum, len(data))
        for k in range(at + minimum, end + 1):
            h = 0
            for byte in data[max(0, k - 32) : k]:
                h = ((h << 1) + int(fingerprints._GEAR[byte])) & 0xFFFFFFFF
            need = bits + 2 if k < at + normal else bits - 2
            if h >> (32 - need) == 0:
                end = k
                break
        ends.append(end)
        at = end
    return ends + ([len(data)] if at < len(data) else [])


def test_boundaries():
    rng = np.random.default_rng(4)
    for n in (1, 16, 17, 400, 3000):
        raw = rng.integers(97, 110, n, dtype=np.uint8)
        assert fingerprints.boundaries(raw, 16, 64, 256) == slow_boundaries(raw.tobytes(), 16, 64, 256)
    same = np.full(1000, 97, dtype=np.uint8)
    assert fingerprints.boundaries(same, 16, 64, 256) == slow_boundaries(same.tobytes(), 16, 64, 256)


def expanded(rows, least):
    """The pairs (document, holder): containment that the classes and links stand for."""
    rows = [tuple(r) for r in rows]
    members, size, out = {}, {}, {}
    for i, c, n, other, _, _ in rows:
        if other is None:
            members.setdefault(c, []).append(i)
            size[i] = n
    for _, c, _, other, shared, _ in rows:
        for i in members[c] if other is not None else []:
            if shared >= least * size[i]:
                out |= {(i, j): shared / size[i] for j in members[other] if i != j}
    return out


def all_contained(texts, least, *sizes):
    sets = {i: fingerprints.chunks_of(t, *sizes) for i, t in texts.items()}
    out = {}
    for a in sets:
        for b in sets:
            c = sum(w for d, w in sets[a].items() if d in sets[b]) / max(1, sum(sets[a].values()))
            if a != b and c >= least:
                out[a, b] = pytest.approx(c)
    return out


def test_containment(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(400)]
    base = " ".join(rnd.choices(words, k=900))
    texts = {1: base, 2: "inserted in front " + base, 3: base[:3000], 4: " ".join(rnd.choices(words, k=700)), 5: base + " " + " ".join(rnd.choices(words, k=300)), 6: base[3000:], 7: base, 8: base[2000:5000]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = expanded(fingerprints.containment(df).collect(), 0.5)
    assert got == all_contained(texts, 0.5, 128, 512, 2048) and {(2, 1), (1, 2), (3, 1), (1, 5), (7, 1), (3, 2)} <= set(got) and not any(4 in p for p in got)


def test_a_passage_that_many_hold_makes_few_classes(spark, monkeypatch):
    """Texts with nothing but a passage in common differ in where its first chunk begins; links between those classes stand for all pairs."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrst", k=rnd.randint(2, 9)))
    passage = " ".join(word() for _ in range(80))
    texts = {i: " ".join(word() for _ in range(rnd.choice([20, 60, 600]))) + " " + passage + " " + " ".join(word() for _ in range(20)) for i in range(200)}
    texts |= {300 + i: texts[3] for i in range(10)} | {400: texts[5] + " and more words behind it"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = fingerprints.containment(df, **queries.CONTAINMENT).collect()
    pairs = expanded(rows, 0.2)
    assert pairs == all_contained(texts, 0.2, 8, 32, 128)
    print(len(pairs), sum(r["contained_in"] is not None for r in rows))
    assert sum(r["contained_in"] is not None for r in rows) < len(pairs) / 5
    # chunks that are split over tasks, and broadcast as hot ones, give the same rows
    monkeypatch.setattr(fingerprints, "PART", 7)
    monkeypatch.setattr(fingerprints, "lookup", lambda *a: common.lookup(*a, least=20))
    monkeypatch.setattr(common, "MOST_HOT", 10**9)
    assert sorted(map(str, fingerprints.containment(df, **queries.CONTAINMENT).collect())) == sorted(map(str, rows))


def test_links_are_counted_as_they_are_listed(spark, monkeypatch):
    """Short texts within long ones, copies, a class whose members differ in length, and blocks of any size: every document's count is that of brute force."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrst", k=rnd.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    passages = [some(k) for k in (30, 60, 90)]
    texts = {i: some(rnd.choice([0, 10, 40, 150])) + " " + " ".join(rnd.sample(passages, rnd.choice([1, 1, 2]))) + " " + some(rnd.choice([0, 20])) for i in range(90)}
    texts |= {200 + i: p for i, p in enumerate(passages)} | {300 + i: texts[i % 3] for i in range(9)} | {400: some(50)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = all_contained(texts, 0.2, 8, 32, 128)
    want = {i: sum(a == i for a, _ in pairs) for i in texts}
    for part, most in ((fingerprints.PART, fingerprints.ENTRIES), (300, 50)):
        monkeypatch.setattr(fingerprints, "PART", part)
        monkeypatch.setattr(fingerprints, "ENTRIES", most)
        rows = fingerprints.links(df, **queries.CONTAINMENT).collect()
        got = {r["doc_id"]: r["n_links"] for r in rows}
        assert len(rows) == len(got) and 400 not in got and all(want[i] == got.get(i, 0) for i in texts)
        members = fingerprints.containment(df, **queries.CONTAINMENT).where("contained_in is null").collect()
        assert sorted(r[:3] for r in members) == sorted(r[:3] for r in rows)
    assert len({r["n_bytes"] for r in rows if r["n_links"] > 0}) > 50 and sum(want.values()) > 10 * len(texts)


def test_shuffle_files_go_with_their_query(spark):
    """What is written and cut leaves no shuffle file behind, though the driver has not collected its garbage; other queries are as they were."""
    docs = spark.createDataFrame([(i, f"one text that many hold, and its number {i % 7}") for i in range(400)], "doc_id long, text string")
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(), spark.conf.get(key)
    with common.shuffles_dropped(spark):
        common.cut(docs.repartition(5, "doc_id"))
    assert spark.conf.get(key) == setting
    until = time.time() + 10  # the files are deleted in the background
    while held() > before and time.time() < until:
        time.sleep(0.1)
    assert held() <= before


def test_scattered_edits_are_found(spark, tmp_path):
    """The query's recall on near copies with a word changed about every 160 bytes."""
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(5000)]
    texts = {}
    for g in range(60):
        base = rnd.choices(words, k=rnd.choice([60, 150, 600]))
        texts[2 * g] = " ".join(base)
        texts[2 * g + 1] = " ".join(rnd.choice(words) if rnd.random() < 1 / 25 else w for w in base)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    pairs = expanded(fingerprints.containment(df, **queries.CONTAINMENT).collect(), 0.2)
    assert pairs == all_contained(texts, 0.2, 8, 32, 128)
    counted = {r["doc_id"]: r["n_links"] for r in queries.op2_fingerprints(spark, str(tmp_path)).collect()}
    assert all(counted.get(i, 0) == sum(a == i for a, _ in pairs) for i in texts)
    got = {tuple(sorted(p)) for p in pairs}
    want = {(2 * g, 2 * g + 1) for g in range(60)}
    assert len(got & want) >= 0.9 * 60 and len(got - want) <= 1


# 3: HTML


def test_density_by_recursion():
    page = "<html><body><nav><a href=1>Home</a><a href=2>About us</a></nav><div id=m><p>A long first paragraph of the text, with <a href=3>one link</a> in it and more words after it.</p><p>Second paragraph, also with quite a lot of words in it.</p></div><footer><a>c</a> 2024</footer></body></html>"
    body, nodes = html_density.measure(html_density.parse(page))

    def count(node, inside=False):
        inside = inside or node.tag == "a"
        c = t = lc = lt = 0
        for p in node.parts:
            if isinstance(p, str):
                c += len(p.replace(" ", ""))
                lc += len(p.replace(" ", "")) * inside
            else:
                sub = count(p, inside)
                c, t, lc, lt = c + sub[0], t + sub[1] + 1, lc + sub[2], lt + sub[3] + (p.tag == "a" or inside)
        return c, t, lc, lt

    ratio = count(body)[2] / count(body)[0]
    for node in nodes:
        c, t, lc, lt = count(node)
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        assert node.density == pytest.approx(c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(base))
    text = html_density.extract(page)[0]
    assert "first paragraph" in text and "Second paragraph" in text and "About us" not in text and "2024" not in text


@pytest.mark.parametrize("page,want", [("", ""), (None, ""), ("<p>only", "only"), ("<body></body>", ""), ("plain &amp; simple", "plain & simple"), ("<div>" * 3000 + "deep text here", "deep text here"), ("<script>x</script><body>a<b>c</body>", "ac")])
def test_odd_pages(page, want):
    assert html_density.extract(page)[0] == want


@pytest.mark.parametrize("page", ["<a " * 250_000, '<a "' * 250_000, '<a =">" ' * 125_000, "<b>" * 60_000 + "<hr>" * 60_000, "<div>" * 60_000 + "</b>" * 60_000, "<!" * 250_000, "<td><table>" + "<b>" * 60_000 + "<td>" * 30_000])
def test_long_malformed_pages_take_linear_time(page):
    began = time.time()
    html_density.extract(page)
    assert time.time() - began < 10


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a<p>b<ul><li>c<li>d</ul>", [("p", 0), ("p", 0), ("ul", 0), ("li", 1), ("li", 1)]),
        ("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table>d</table>", [("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 2), ("table", 3), ("tr", 4), ("td", 5)]),
        ("<div><b>x</i></div></b><p title='a>b' id=\"c\">y</p><br/>z", [("div", 0), ("b", 1), ("p", 0), ("br", 0)]),
        ("<p>a <a href=\"x>link</a> b</p>", [("p", 0), ("a", 1)]),
        ("<ul><li><p>a<li>b</ul><dl><dt>c<dd>d<dt>e</dl>", [("ul", 0), ("li", 1), ("p", 2), ("li", 1), ("dl", 0), ("dt", 1), ("dd", 1), ("dt", 1)]),
    ],
)
def test_implied_ends(page, want):
    def walk(node, depth):
        for p in node.parts:
            if isinstance(p, html_density.Node):
                yield p.tag, depth
                yield from walk(p, depth + 1)

    assert list(walk(html_density.parse(page), 0)) == want


def test_ties_take_the_first_node():
    same = "<div><p>some words of the text that are equal</p><p>some words of the text that are equal</p></div>"
    body, nodes = html_density.measure(html_density.parse(f"<body>{same}{same}</body>"))
    divs = [n for n in nodes if n.tag == "div"]
    assert divs[0].total == divs[1].total and max(nodes, key=lambda n: n.total) in (body, divs[0])
    counted = html_density.measure(html_density.parse("<body>a&amp;b &#65;</body>"))[0]
    assert counted.chars == 4


# 4: neighbours


def test_neighbour_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 24)) + 2 * rng.normal(size=(12, 24))[rng.integers(0, 12, 6000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype("float32"))], "vec_id long, embedding array<float>")
    u = x.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :10]
    got: dict[int, set] = {}
    for r in ann.neighbours(df, 10).collect():
        assert r["similarity"] == pytest.approx(s[r["vec_id"], r["neighbour"]])
        got.setdefault(r["vec_id"], set()).add(r["neighbour"])
    assert len(got) == 6000 and np.mean([len(got[i] & set(w.tolist())) / 10 for i, w in enumerate(want)]) >= 0.9
    # blocks cut into parts, and several blocks, give the same rows
    few = df.where("vec_id < 300")
    rows = lambda **k: sorted(map(tuple, ann.neighbours(few, 5, every=3, **k).select("vec_id", "neighbour", "rank").collect()))
    assert rows() == rows(block=40) and {r[0] for r in rows()} == set(range(0, 300, 3))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    """The registered query against brute force over all rows; not all cells are probed."""
    x = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, u = x["vec_id"].to_numpy(), np.stack(x["embedding"].to_numpy()).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 50 == 0)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    got: dict[int, list] = {}
    for r in queries.op4_cross_polytope(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour"])
    hashes, probes = ann.plan(len(ids), u.shape[1])
    assert probes < 0.5 * math.prod(hashes) and set(got) == set(ids[asked].tolist())
    assert np.mean([len(set(got[int(ids[q])]) & set(ids[np.argsort(-s[i])[:10]].tolist())) / 10 for i, q in enumerate(asked)]) >= 0.9


def test_ties_and_copies_of_vectors(spark):
    """Of 200 copies of one vector, each query gets the smallest other ids; all of the copies are queries."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype("float32")
    x[200:] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict[int, list] = {}
    for r in ann.neighbours(df, 3).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour"])
    assert all(got[i] == [j for j in (7, 200, 201, 202) if j != i][:3] for i in (7, *range(200, 400))) and len(got) == 400


def test_several_hashes():
    hashes, probes = ann.plan(10**6, 64)
    assert hashes == [128, 32] and probes < 0.2 * math.prod(hashes)
    x = np.random.default_rng(1).normal(size=(50, 64))
    codes = ann.cells(x, 0, hashes, 3, 5)
    assert codes.shape == (50, 3) and (codes[:, 0] == ann.cells(x, 0, hashes, 1, 5)[:, 0]).all() and codes.max() < 1 << 12


@pytest.mark.parametrize("n", [500, 51_282, 1_000_000])
def test_planned_recall(n):
    """Other uniform pairs than the plan's own, at the cosines of the 10 nearest of n."""
    hashes, probes = ann.plan(n, 64)
    q, p = ann.simulated_pairs(n, 64, 10, 77)
    found = np.zeros(len(q), dtype=bool)
    for t in range(3):
        found |= (ann.cells(q, t, hashes, probes, 5) == ann.cells(p, t, hashes, 1, 5)).any(axis=1)
    assert found.mean() >= 0.93


# 5: rules


def all_rules(toks, bad, min_bad=5, confidence=0.6, sizes=(1, 2, 3, 4)):
    """Every rule by enumeration, with alike tokens represented by the shortest, pruned by subsets: items to confidence and bad rows."""
    holders = {t: frozenset(i for i, x in enumerate(toks) if t in x) for t in set().union(*toks)}
    first = [t for t in sorted(holders) if t == min((u for u in holders if holders[u] == holders[t]), key=lambda u: (len(u), u))]
    want = {}
    for size in sizes:
        for items in combinations(first, size):
            held = frozenset.intersection(*(holders[t] for t in items))
            n_bad = sum(bad[i] for i in held)
            if n_bad >= min_bad and n_bad / len(held) >= confidence:
                want[items] = (n_bad / len(held), n_bad)
    return {i: c for i, c in want.items() if not any(set(j) < set(i) and want[j][0] >= c[0] for j in want)}


def test_rules(spark):
    rnd = random.Random(6)
    bad = lambda h, p, z: (h == "spam" and p == "buy") or (h == "blog" and z == "org" and rnd.random() < 0.8)
    urls = [(f"https://{h}.example.{z}/{p}/{rnd.randint(1, 99)}?{k}=1", bad(h, p, z)) for h in ("spam", "news", "blog") for z in ("com", "org") for p in ("buy", "read") for k in ("a", "b") for _ in range(6)]
    df = spark.createDataFrame(urls, "url string, bad boolean")
    toks = [set(r[0]) for r in df.select(url_rules.tokens_of(F.col("url"))).collect()]
    want = all_rules(toks, [b for _, b in urls])
    rules = url_rules.mine(df, min_support=0.002)
    assert {tuple(r["tokens"]): (r["confidence"], r["n_bad"]) for r in rules.collect()} == {k: (pytest.approx(c), n) for k, (c, n) in want.items()}
    flagged = url_rules.flag(df.withColumn("n", F.monotonically_increasing_id()), rules).collect()
    assert len(flagged) == len(urls) and any(r["blocked"] for r in flagged) and not all(r["blocked"] for r in flagged)
    for r in flagged:
        mine = set(spark_tokens(spark, r["url"]))
        hits = sorted((-c, -n, i) for i, (c, n) in want.items() if set(i) <= mine)
        assert r["blocked"] == bool(hits) and tuple(r["matched_rule"] or ()) == (hits[0][2] if hits else ())
    assert url_rules.mine(df.where("not bad")).count() == 0


_tokens: dict = {}


def spark_tokens(spark, url):
    if url not in _tokens:
        _tokens[url] = spark.createDataFrame([(url,)], "u string").select(url_rules.tokens_of(F.col("u"))).first()[0]
    return _tokens[url]


def test_rule_of_four_tokens(spark):
    """Bad only where scheme, host label, path and key come together; every three of them are mostly good."""
    urls = []
    for bits in range(16):
        s, h, p, k = ("ab"[bits >> i & 1] for i in range(4))
        urls += [(f"{'http' if s == 'a' else 'ftp'}://{h}{i}q.{h}/{p}?{k}=1", bits == 0) for i in range(10)]
    df = spark.createDataFrame(urls, "url string, bad boolean")
    rules = {tuple(r["tokens"]): r["confidence"] for r in url_rules.mine(df).collect()}
    assert rules[("key:a", "label:a", "path:a", "scheme:http")] == 1.0
    assert url_rules.flag(df, url_rules.mine(df)).where("blocked <> bad").count() == 0


def test_long_urls_are_mined_in_bounded_time(spark):
    """16 bad URLs with 40 path segments each, of which good URLs have some too."""
    path = lambda n: "/".join("".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(n))
    urls = [(f"http://bad.example.com/{path(40)}?x=1", True)] * 16 + [(f"http://good.example.com/{path(3)}?x=1", False)] * 16
    began = time.time()
    rules = {tuple(r["tokens"]): r["confidence"] for r in url_rules.mine(spark.createDataFrame(urls, "url string, bad boolean")).collect()}
    assert time.time() - began < 60 and rules and set(rules.values()) == {1.0}


# 7: near duplicates


def test_near_duplicates(spark):
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    texts = {}
    for g in range(40):
        base = rnd.choices(words, k=rnd.choice([30, 80, 300]))
        for copy in range(rnd.choice([1, 2, 5])):
            t = list(base)
            for _ in range(copy * len(t) // 60):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts[len(texts) * 3 + 1] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sets = {i: near_dedup.shingles_of(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    for i, j in combinations(sorted(texts), 2):
        if near_dedup.jaccard(sets[i], sets[j]) >= 0.5 and group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = {k: low if v == high else v for k, v in group.items()}
    want = {i: g for i, g in group.items() if i != g}
    got = {r[0]: r[1] for r in near_dedup.groups(df).collect()}
    assert len(want) > 20 and len(set(want.items()) & set(got.items())) >= 0.95 * len(want) and not set(got) - set(want)
    assert got == {r[0]: r[1] for r in near_dedup.groups(df, broadcast_ids=0).collect()}


def test_star_shaped_group(spark):
    """70 copies of one text, most of them nearer to it than to each other: all links within buckets count."""
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    base = rnd.choices(words, k=150)
    texts = {i: " ".join(rnd.choice(words) if rnd.random() < 0.1 else w for w in base) for i in range(1, 71)} | {500: " ".join(base)}
    sets = {i: near_dedup.shingles_of(t) for i, t in texts.items()}
    keys = {i: set(near_dedup.band_keys(near_dedup.signature(s, 128, 11), 32).tolist()) for i, s in sets.items()}
    group = {i: i for i in texts}
    for i, j in combinations(sorted(texts), 2):
        if keys[i] & keys[j] and near_dedup.jaccard(sets[i], sets[j]) >= 0.5 and group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = {k: low if v == high else v for k, v in group.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {i: g for i, g in group.items() if i != g}
    assert len(want) > 50 and {r[0]: r[1] for r in near_dedup.groups(df).collect()} == want


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    x, y = near_dedup.signature(np.concatenate([both, a]), 2048, 11), near_dedup.signature(np.concatenate([both, b]), 2048, 11)
    assert abs((x == y).mean() - 0.6) < 0.06
    some = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    mix = lambda v: int(near_dedup.mix32(np.array([v % (1 << 32)], dtype=np.uint32))[0])
    scattered = [mix((int(s) >> 32) ^ (3 * 0x9E3779B1 % (1 << 32))) for s in some]
    assert near_dedup.signature(some, 16, 3).tolist() == [min(mix(x + k) for x in scattered) for k in range(16)]
    assert len(np.unique(near_dedup.mix32(np.arange(1 << 20, dtype=np.uint32)))) == 1 << 20


def test_long_disjoint_texts_share_no_band():
    rng = np.random.default_rng(4)
    keys = [near_dedup.band_keys(near_dedup.signature(rng.integers(0, 1 << 63, 1_500_000, dtype=np.uint64), 128, 11), 32) for _ in range(2)]
    assert not set(keys[0].tolist()) & set(keys[1].tolist())


def test_a_text_repeated_100000_times(spark, monkeypatch):
    """Copies are joined without a task for them all: as a hot key by broadcast, and by shuffle, with the same rows."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda x: F.concat(F.lit("w"), (x * F.col("g")).cast("string"))), " ")
    df = spark.range(100_500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 201 == 0, F.col("id") + 7).otherwise(1).alias("g")).select("doc_id", words.alias("text"))
    got = {r[0]: r[1] for r in near_dedup.groups(df).collect()}
    assert got == {i: 1 for i in range(100_500) if i % 201 and i != 1}
    monkeypatch.setattr(near_dedup, "lookup", lambda *a: common.lookup(*a, least=50_000))
    assert got == {r[0]: r[1] for r in near_dedup.groups(df).collect()}


def test_components(spark, monkeypatch):
    rnd = random.Random(2)
    edges = [(i, i - 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(edges, "__id long, __leader long")
    want = {r[0]: r[1] for r in near_dedup.components(df, 1000).collect()}
    assert want[39] == 0 and want[129] == 100 and {r[0]: r[1] for r in near_dedup.components(df).collect()} == want


def test_parts_of_buckets_and_leaders_change_nothing(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    base = rnd.choices(words, k=150)
    df = spark.createDataFrame([(i, " ".join(rnd.choice(words) if rnd.random() < 0.08 else w for w in base)) for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, near_dedup.groups(df).collect()))
    monkeypatch.setattr(near_dedup, "PART", 3)
    monkeypatch.setattr(near_dedup, "CHUNK", 2)
    assert want and sorted(map(tuple, near_dedup.groups(df).collect())) == want


# 8: language


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and length(text) > 40")
    model = language_id.fit_on(train, sample_per_language=60)
    rows = language_id.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in rows]) > 0.97 and np.mean([r["accepted"] for r in rows]) > 0.98


def test_backoff():
    model = language_id.fit([("the cat the dog", "en"), ("le chat le chien", "fr")], min_count=1)
    assert model.word_scores("the").tolist() == [pytest.approx(-math.log10(0.5)), 7.0]
    counts = lambda n: Counter(g for w in ("le", "chat", "le", "chien") for g in language_id.grams_of(w, n))
    four, three = counts(4), counts(3)
    # " chaxy " has no known 5-gram and one known 4-gram; " chox " has one known 3-gram
    assert model.word_scores("chaxy")[1] == pytest.approx(-math.log10(four[" cha"] / four.total()))
    assert model.word_scores("chox")[1] == pytest.approx(-math.log10(three[" ch"] / three.total()))
    assert model.word_scores("ωωω").tolist() == [7.0, 7.0]


def slow_identify(rows, text, max_score, min_margin):
    """Word-first backoff from the counts themselves, one word after another."""
    words = lambda t: language_id.WORD.findall(t.lower())
    languages = sorted({lang for _, lang in rows})
    known = {k: Counter(w for t, lang in rows if lang == k for w in words(t)) for k in languages}
    grams = {k: [Counter() for _ in range(6)] for k in languages}
    for k in languages:
        for w, c in known[k].items():
            for n in range(1, 6):
                for g in language_id.grams_of(w, n):
                    grams[k][n][g] += c * (g != " ")
    score = lambda counter, item: min(7.0, -math.log10(counter[item] / counter.total())) if counter[item] >= 2 else 7.0
    found = words(text or "")
    if not found:
        return None, None, None, 0, False
    sums = dict.fromkeys(languages, 0.0)
    for w in found:
        if any(known[k][w] >= 2 for k in languages):
            for k in languages:
                sums[k] += score(known[k], w)
            continue
        for n in range(5, 0, -1):
            hits = [g for g in language_id.grams_of(w, n) if any(grams[k][n][g] >= 2 for k in languages)]
            if hits:
                break
        for k in languages:
            sums[k] += sum(score(grams[k][n], g) for g in hits) / len(hits) if hits else 7.0
    means = sorted((s / len(found), k) for k, s in sums.items())
    margin = means[1][0] - means[0][0]
    return means[0][1], means[0][0], margin, len(found), means[0][0] <= max_score and margin >= min_margin


def test_identify_against_one_word_at_a_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["text"], r["lang"]) for r in docs.where("text is not null and lang is not null and doc_id % 2 = 0").collect()]
    model = language_id.fit(rows)
    texts = [r["text"] for r in docs.where("doc_id % 2 = 1").limit(40).collect()] + ["Zyx qqq der the", "123 !", "", None, "ωω", rows[0][0][:300] + " " + rows[-1][0][:300]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.identify(df, model, max_score=6.0, min_margin=0.15).collect():
        want = slow_identify(rows, texts[r["doc_id"]], 6.0, 0.15)
        assert (r["language"], r["score"], r["margin"], r["n_words"], r["accepted"]) == (want[0], want[1] and pytest.approx(want[1]), want[2] and pytest.approx(want[2]), *want[3:])


def test_scores_do_not_depend_on_what_was_scored_before(monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 7))) for _ in range(3000)]
    model = language_id.fit([(" ".join(rnd.choices(words, k=4000)), "x"), (" ".join(rnd.choices(words, k=4000)), "y")])
    text = " ".join(rnd.choices(words[:50], k=900))
    alone = language_id.score_texts(model, [text], 9, 0)
    language_id.score_texts(model, [" ".join(words[::-1])], 9, 0)
    after = language_id.score_texts(model, [text], 9, 0)
    monkeypatch.setattr(language_id, "KEPT_WORDS", 10)
    assert alone.equals(after) and alone.equals(language_id.score_texts(model, [text], 9, 0))


# 9: pieces


@pytest.fixture(scope="module")
def pieces():
    return piece_viterbi.load()


def slow_viterbi(table, unknown, word):
    best = [(0.0, [])] + [(-math.inf, None)] * len(word)
    for b in range(1, len(word) + 1):
        best[b] = (best[b - 1][0] + unknown, best[b - 1][1] + [None])
        for a in range(b - 1, -1, -1):
            piece = word[a:b]
            if piece in table and best[a][0] + table[piece][1] >= best[b][0]:
                best[b] = (best[a][0] + table[piece][1], best[a][1] + [piece])
    return best[-1][0]


def test_pieces_are_the_best_segmentation(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_viterbi.MODEL)
    table = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for word in ["▁the", "▁transformation", "▁xyzzyplugh", "▁ééà", "▁漢字kanji", "▁▁▁", "▁a"]:
        ids = piece_viterbi.encode_texts(pieces, [word.replace("▁", " ")[1:]])[0]
        score, rest = 0.0, word
        for i in ids:
            p = sp.id_to_piece(int(i))
            score += table[p][1] if p in table else 0.0
        n_unknown = sum(c not in table for c in word)
        assert score + n_unknown * pieces.unknown == pytest.approx(slow_viterbi(table, pieces.unknown, word))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_round_trip(texts):
    pieces = test_round_trip.pieces = getattr(test_round_trip, "pieces", None) or piece_viterbi.load()
    texts = [t.replace("▁", "_") for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert piece_viterbi.decode_many(pieces, piece_viterbi.encode_texts(pieces, texts)) == texts


def test_slices_and_forgetting_change_nothing(pieces, monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choices("abcdé\n", k=rnd.randint(1, 9))) for _ in range(50)) for _ in range(40)] + [None, ""]
    want = piece_viterbi.encode_texts(pieces, texts)
    monkeypatch.setattr(piece_viterbi, "SLICE_CHARS", 300)
    monkeypatch.setattr(piece_viterbi, "KEPT_WORDS", 20)
    fresh = piece_viterbi.load()
    assert [None if x is None else x.tolist() for x in piece_viterbi.encode_texts(fresh, texts)] == [None if x is None else x.tolist() for x in want]


def test_long_words(pieces, monkeypatch):
    """The way for long words gives what the batched one gives, and a million characters without a space take seconds."""
    rnd = random.Random(6)
    for size in (1, 2, 30, 250, 1200):
        words = ["▁" + "".join(rnd.choices("abcdefghijklmnopqrst漢é\U0001f600", k=size)) for _ in range(3)] + ["a" * (size + 1)]
        each = [piece_viterbi.long_viterbi(pieces, w) for w in words]
        with monkeypatch.context() as m:
            m.setattr(piece_viterbi, "LONG_WORD", 0)
            flat, sizes = piece_viterbi.viterbi(pieces, words)
        assert np.concatenate(each).tolist() == flat.tolist() and [len(x) for x in each] == sizes.tolist()
    word, began = "".join(rnd.choices("abcdefghijklmnopqrst漢é", k=1_000_000)), time.time()
    ids = piece_viterbi.encode_texts(pieces, [word])[0]
    assert piece_viterbi.decode_ids(pieces, ids) == word and time.time() - began < 60


def test_decoded_column(spark):
    df = spark.createDataFrame([("a b\nc",), (None,), ("",)], "text string")
    ids = df.select("text", piece_viterbi.encoded(df).alias("ids"))
    assert all(r[0] == r[1] for r in ids.select("text", piece_viterbi.decoded(ids)).collect())


# 6 and 10


def test_packing(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 60), " ".join(rnd.choices("abc", k=rnd.randint(0, 30)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, at = [], 0
    for key, text in sorted(rows):
        tokens = text.split()
        for k, tok in enumerate(tokens):
            w, p = divmod(at, 7)
            if k and want[-1][0] == w:
                want[-1] = (*want[-1][:2], p + 1, key, want[-1][4], k + 1, want[-1][6] + " " + tok)
            else:
                want.append((w, p, p + 1, key, k, k + 1, tok))
            at += 1
    for ranges in (1, 3, 16):
        assert sorted(map(tuple, packing.pack(df, 7, ranges=ranges).collect())) == sorted(want)
    with pytest.raises(ValueError):
        packing.pack(df, 0)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "decimal(9,2)", "double"])
def test_packing_of_other_ids(spark, kind):
    df = spark.createDataFrame([(i % 40, f"a{i} b c") for i in range(300)] + [(None, "x y")], "n int, text string")
    typed = df.select((F.expr("date'2024-01-01' + n") if kind != "decimal(9,2)" and kind != "double" else F.col("n")).cast(kind).alias("doc_id"), "text", "n")
    rows = sorted(packing.pack(typed, 16, ranges=200).collect(), key=lambda r: (r["window_id"], r["window_start"]))
    assert " ".join(r["text"] for r in rows) == " ".join(r["text"] for r in df.orderBy(F.col("n").asc_nulls_first(), "text").collect())
    assert rows[0]["doc_id"] is None and rows[-1]["doc_id"] == typed.agg(F.max("doc_id")).first()[0]


def test_packing_of_string_ids(spark):
    with pytest.raises(TypeError):
        packing.pack(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = np.random.default_rng(3).integers(0, 1 << 60, 3000)
    for n in (1, 2, 10, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    before, after = sharding.jump_hash(keys, 10), sharding.jump_hash(keys, 12)
    assert set(after[before != after]) <= {10, 11} and abs((before != after).mean() - 2 / 12) < 0.03
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    out = sharding.assign(df, 8).withColumn("p", F.spark_partition_id())
    assert out.select("shard", "p").distinct().count() == 8
    assert sharding.moved(df, 8, 10).where("shard_after < 8").count() == 0


def test_odd_keys(spark):
    """Empty and very long strings are keys like any other, null is in shard 0, and equal keys are together."""
    import hashlib

    keys = ["", "x" * 1_000_000, "é", None, "", " "]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id string")
    got = [r["shard"] for r in sharding.assign(df, 7, together=False).collect()]
    assert got == [0 if k is None else slow_jump(int(hashlib.md5(k.encode()).hexdigest()[:15], 16), 7) for k in keys]
