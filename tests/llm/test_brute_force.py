"""Each operator against a plain version of what it computes."""

from __future__ import annotations

import itertools
import json
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from modaleda.llm import chosen_path, heavy_dedup, html_content, licenses, mixing, packing, repeats, token_counts, topk, toxicity

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def random_text(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int, n: int) -> list[tuple[int, str]]:
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    passages = [random_text(rng, 60) for _ in range(3)]
    out: list[list[str]] = []
    for i in range(n):
        kind = rng.random()
        if i and kind < 0.15:
            t = list(rng.choice(out))
        elif i and kind < 0.45:
            t = list(rng.choice(out))
            for _ in range(rng.randrange(1, 12)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(1000)}"
        else:
            t = random_text(rng, rng.randrange(5, 120))
        if kind > 0.85:
            at = rng.randrange(len(t))
            t[at:at] = rng.choice(passages)
        out.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def table(spark, rows, source=False):
    if source:
        return spark.createDataFrame([(i, t, ["web", "books", "code"][i % 3 % 2 + (i % 7 == 0)]) for i, t in rows], "doc_id long, text string, source string")
    return spark.createDataFrame(rows, "doc_id long, text string")


# 1 license scans


def test_longest_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        second = rng.sample(range(30), rng.randrange(0, 9))
        pairs = list(enumerate(second))
        got = licenses._increasing(pairs)
        best = max((len(c) for k in range(len(pairs) + 1) for c in itertools.combinations(pairs, k) if all(a[1] < b[1] for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best and all(a < b and x < y for (a, x), (b, y) in zip(got, got[1:]))


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(100):
        a, b = [random_text(rng, rng.randrange(0, 40), 12) for _ in range(2)]
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))


def test_license_scan_finds_what_every_window_finds(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        name = rng.choice(list(licenses.TEMPLATES))
        t = licenses.tokens(licenses.TEMPLATES[name])
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(t))
            rng.choice([lambda: t.__setitem__(at, "zz"), lambda: t.insert(at, "zz"), lambda: len(t) > 1 and t.pop(at)])()
        rows.append((i, " ".join(random_text(rng, rng.randrange(0, 30)) + t + random_text(rng, rng.randrange(0, 30)))))
    got = {(r.doc_id, r.license) for r in licenses.license_scan(table(spark, rows)).collect()}
    want = set()
    for i, text in rows:
        words = licenses.tokens(text)
        for name, template in licenses.TEMPLATES.items():
            m = licenses.tokens(template)
            slack = -(-len(m) // 2)
            for s in range(len(words)):
                lo, hi = max(0, s - slack), min(len(words), s + len(m) + slack)
                a = licenses.align(words[lo:hi], m)
                if a and len(a) / len(m) >= 0.9 - 1e-9 and a[-1][0] + 1 - a[0][0] <= 1.5 * len(m) + 1e-9:
                    want.add((i, name))
    assert got <= want
    assert len(got) >= 0.98 * len(want) > 60


def test_notices_in_other_words(spark):
    mit = licenses.TEMPLATES["MIT-text"].replace("Software", "Program", 2).replace("AUTHORS", "X CONSORTIUM")
    planted = [
        ("All rights reserved.", "all-rights"), ("Copyright 2024 Acme Corp. All rights reserved.", "all-rights"), ("(c) 2020 A. Author, all rights are reserved", "all-rights"),
        ("Licensed under the MIT License", "MIT"), ("It is available under the MIT license.", "MIT"), ("Licensed under the Apache License 2.0", "Apache-2.0"), ("under the Apache License, Version 2.0", "Apache-2.0"),
        ("free under the GNU General Public License v3", "GPL-3.0"), ("shared as CC BY-NC 4.0", "CC-BY-NC-4.0"), ("under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"), (mit, "MIT-text"),
    ]
    rows = [(i, f"some words before {t} and some words after") for i, (t, _) in enumerate(planted)] + [(99, "Released under the BSD License. Some rights are reserved, and the license is long.")]
    got = {(r.doc_id, r.license) for r in licenses.license_scan(table(spark, rows)).collect()}
    assert all(any(i == d and n.startswith(name) for d, n in got) for i, (_, name) in enumerate(planted))
    assert all(d != 99 for d, _ in got)


def test_a_notice_before_words_like_its_own(spark):
    texts = [
        "here is our code Released under the MIT License. See the license for more",
        "one two three the license is this: Released under the MIT License and the license is short",
        "a b c d e f License is below. Licensed under CC BY-NC 4.0. Licensed 4.0 under it",
    ]
    got = {(r.doc_id, r.license): (r.coverage, r.first_word, r.end_word) for r in licenses.license_scan(table(spark, list(enumerate(texts)))).collect()}
    assert got[0, "MIT"] == (1.0, 4, 9) and got[1, "MIT"] == (1.0, 7, 12) and got[2, "CC-BY-NC-4.0"] == (1.0, 9, 14)


# 2 mixing


def test_apportionment_gives_the_highest_quotients():
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0}
    seats = mixing.sainte_lague(weights, 7)
    quotients = sorted(((w / (2 * k + 1), s) for s, w in weights.items() for k in range(7)), reverse=True)[:7]
    assert seats == {s: sum(q[1] == s for q in quotients) for s in weights} and sum(seats.values()) == 7
    assert mixing.sainte_lague({}, 5) == {}


def test_every_shard_has_the_quota_of_blocks(spark):
    rng = random.Random(4)
    docs = table(spark, [(i, " ".join(random_text(rng, rng.randrange(1, 40)))) for i in range(600)], source=True)
    rows = mixing.assignments(docs, {"web": 3, "books": 1, "code": 1}, block_tokens=50, blocks_per_shard=10).collect()
    quota = mixing.sainte_lague({"web": 3, "books": 1, "code": 1}, 10)
    plan = {s: b // q for s, b, q, _, _ in mixing._plan({s: sum(r.n_tokens for r in mixing.assignments(docs, block_tokens=1).collect() if r.source == s) for s in quota}, {"web": 3, "books": 1, "code": 1}, 0.7, 50, 10, 0.9, "mix")}
    shards = {r.shard for r in rows if r.shard < min(plan.values())}
    assert len(shards) > 2
    blocks = defaultdict(set)
    for r in rows:
        blocks[r.shard, r.source].add(r.block)
    assert all(len(blocks[h, s]) == q for h in shards for s, q in quota.items())
    assert len({(r.source, r.block) for r in rows}) == sum(map(len, blocks.values()))  # no block is in two shards
    assert all(len(b) <= quota[s] for (_, s), b in blocks.items())


@pytest.mark.parametrize("blocks", [1, 2, 7, 42, 1000, 4_194_305, 5_000_000_000, (1 << 40) - 1])
def test_blocks_are_permuted(spark, blocks):
    stride, shift = mixing.stride_of("web", blocks, "mix"), 12345 % blocks
    asked = sorted(b for b in {0, 1, blocks // 2, blocks - 1, *range(min(blocks, 1000))} if b < blocks)
    F = mixing.F
    slot = mixing.slot_of(F.col("b"), F.lit(blocks), F.lit(stride), F.lit(shift))
    got = [r[0] for r in spark.createDataFrame([(b,) for b in asked], "b long").select(slot).collect()]
    assert got == [(b * stride + shift) % blocks for b in asked] and len(set(got)) == len(asked) and all(0 <= g < blocks for g in got)
    assert blocks < 8 or stride > 1


def test_a_tiny_source_does_not_hold_up_the_rest():
    totals = {"hot": 10_000_000, "tiny": 2_500, **{f"s{i}": 200_000 for i in range(20)}}
    plan = mixing._plan(totals, None, 0.7, 1024, 512, 0.9, "mix")
    kept = sum(min(b, q * n) for _, b, q, n, _ in plan)
    fills = [(b // q, q) for _, b, q, _, _ in plan]
    n = plan[0][3]
    assert sum(q for f, q in fills if f >= n) >= 0.9 * 512 > sum(q for f, q in fills if f > n)
    assert kept > 6000
    assert mixing._plan({}, None, 0.7, 1024, 512, 0.9, "mix") == []


# 3 repeated spans


@pytest.mark.parametrize(("seed", "hot", "most"), [(1, 50_000, 9), (2, 3, 500_000), (3, 1, 5)])
def test_repeated_spans(spark, monkeypatch, seed, hot, most):
    monkeypatch.setattr(repeats._hot, "__defaults__", (most,))
    rows, length = corpus(seed, 60), 20
    places = defaultdict(list)
    for i, text in rows:
        w = WORD.findall(text)
        for s in range(len(w) - length + 1):
            places[tuple(w[s : s + length])].append((i, s))
    want = set()
    covered = defaultdict(dict)
    for found in places.values():
        if len({i for i, _ in found}) > 1:
            for i, s in found:
                covered[i][s] = len(found)
    for i, at in covered.items():
        run: list[int] = []
        for s in [*sorted(at), 1 << 40]:
            if run and s > run[-1] + length:
                want.add((i, run[0], run[-1] + length, max(at[x] for x in run)))
                run = []
            run.append(s)
    assert {tuple(r) for r in repeats.repeated_spans(table(spark, rows), length, 9, hot).collect()} == want


# 4 HTML


@pytest.fixture(scope="module")
def model():
    return html_content.train(html_content.invented_pages(120, seed=7))


def test_content_of_pages_not_trained_on(model):
    right = letters = 0
    for page in html_content.invented_pages(60, seed=99):
        nodes = html_content.parse(page)
        x, own = model.features(nodes)
        kept = html_content.decode(nodes, model.predict(x), own)
        y = html_content.marked(nodes) > 0
        right += own[kept == y].sum()
        letters += own.sum()
    assert right / letters > 0.95


def blog_page(rng: random.Random) -> str:
    """A page by another hand than the invented ones: tags left out, other names; words of the content begin with q, others with z."""

    def words(c: str, n: int) -> str:
        return " ".join(c + rng.choice(["ato", "ibe", "urn", "elo", "ama"]) + str(rng.randrange(100)) for _ in range(n)) + "."

    menu = "".join(f"<li><a href=/{i}>{words('z', 2)}</a>" for i in range(rng.randrange(3, 9)))
    body = "".join(f"<p>{words('q', rng.randrange(15, 60))} {words('q', rng.randrange(8, 30))}" for _ in range(rng.randrange(2, 9)))
    aside = f"<div class=recent-posts><h3>{words('z', 2)}</h3><ul>{menu}</ul></div>" if rng.random() < 0.7 else ""
    holder = rng.choice(["<div class=blog__txt>{}</div>", "<table><tr><td>{}<tr><td></table>", "<section><div><div>{}</div></div></section>", "<center>{}</center>"])
    return f"<!doctype html><title>x</title><link rel=a><ul id=topnav>{menu}</ul>{holder.format(f'<h1>{words(chr(113), 5)}</h1>' + body)}{aside}<div id=copyright><small>{words('z', 6)}</small></div>"


def test_content_of_pages_by_another_hand(model):
    rng = random.Random(31)
    found = wanted = wrong = 0
    for _ in range(40):
        page = blog_page(rng)
        nodes = html_content.parse(page)
        x, own = model.features(nodes)
        got = Counter(re.findall(r"\b[qz]\w+", html_content.kept_text(nodes, html_content.decode(nodes, model.predict(x), own))))
        want = Counter(re.findall(r"\bq\w+", page))
        wanted += sum(want.values())
        found += sum((got & want).values())
        wrong += sum(n for w, n in got.items() if w[0] == "z")
    assert found >= 0.9 * wanted and wrong <= 0.1 * wanted


def test_what_marks_the_content_is_hidden(model):
    page = "<body><{0}><p>Some words here, and some more.</p></{0}><nav><a>x</a></nav>"
    plain, marked = (model.features(html_content.parse(page.format(t)))[0] for t in ("div", "main"))
    assert (plain == marked).all()
    assert html_content.tokens_of(html_content.Node("div", ' role="main" itemprop="articleBody" class="Post-body x1"', 0, 1, [])) == ["post", "body", "x"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><body><p>text", [("#root", []), ("p", ["text"])]),
        ("a < b <p>c > d", [("#root", ["a < b "]), ("p", ["c > d"])]),
        ("<svg/><p>x</p><iframe src=1><p>y", [("p", ["x"]), ("p", ["y"])]),
        ("<p>a<!-- never closed <p>b", [("p", ["a", " never closed "]), ("p", ["b"])]),
        ('<p class="x>y">q</p><p class="z>r', [("p", ["q"]), ("p", ["r"])]),
        ("<script>var a='<p>no</p>'</script><ul><li>1<li>2</ul>3", [("#root", ["3"]), ("li", ["1"]), ("li", ["2"])]),
    ],
)
def test_broken_markup(page, want):
    got = [(x.tag, [t for _, t in x.text]) for x in html_content.parse(page)]
    assert [w for w in want if w in got] == want


@pytest.mark.parametrize("piece", ["<a ", '<a href="x ', '<a href="x >', "<!--", "<script>", "<", "<b>", "<p><b>", "</b>", "<div>", "<li>x"])
def test_long_broken_pages_take_linear_time(piece):
    began = time.perf_counter()
    html_content.parse(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 15


def test_the_first_split_is_the_best_one():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(200) < 0.1)).astype(float)
    b = html_content.Boosted(trees=1, depth=1, rate=1.0, least=5).fit(x, y, np.ones(200))
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))

    def gain(left):
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)

    best = max((gain(x[:, j] < c), j, c) for j in range(3) for c in range(1, 6) if 5 <= (x[:, j] < c).sum() <= 195)
    feature, cut, value = b.nodes[0]
    assert feature[0] == best[1] and b.edges[best[1]][cut[0]] == best[2]
    left = x[:, best[1]] < best[2]
    assert value[1] == pytest.approx(g[left].sum() / (h[left].sum() + 1)) and b.predict(x)[left][0] == pytest.approx(1 / (1 + np.exp(-(b.base + value[1]))))


def test_decoding_is_the_likeliest_labelling():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        nodes = [html_content.Node("#root", "", -1, 0, [])] + [html_content.Node("div", "", int(rng.integers(0, i)), 1, []) for i in range(1, n)]
        p, letters = rng.random(n), rng.integers(0, 50, n).astype(float)

        def value(labels, p=p, letters=letters, nodes=nodes, n=n):
            total = 0.0
            for i in range(n):
                up = labels[nodes[i].parent] if i else 0
                if up and labels[i] != up:
                    return -np.inf
                yes, no = np.log1p(letters[i]) * np.log(np.clip(p[i], 1e-4, 1 - 1e-4)), np.log1p(letters[i]) * np.log(1 - np.clip(p[i], 1e-4, 1 - 1e-4))
                total += max(yes, no) - 0.5 if labels[i] == 0 else yes if labels[i] == 1 else no
            return total

        best = max(itertools.product((0, 1, 2), repeat=n), key=value)
        got = html_content.decode(nodes, p, letters)
        want = [lab == 1 or (lab == 0 and p[i] > 0.5 and letters[i] > 0) for i, lab in enumerate(best)]
        assert [g for g, x in zip(got, letters) if x] == [w for w, x in zip(want, letters) if x]


# 5 nearest vectors


@pytest.mark.parametrize(("n", "tile", "every"), [(7, 2, 1), (150, 16, 1), (200, 16, 3)])
def test_nearest(spark, n, tile, every):
    rng = np.random.default_rng(n)
    v = rng.integers(-2, 3, (n, 4)).astype(float)  # many ties
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    got = {(r.vec_id, r.rank): (r.neighbor_id, r.similarity) for r in topk.nearest(vectors.where(f"vec_id % {every} = 0"), vectors, 5, tile, 2, 2).collect()}
    norm = np.linalg.norm(v, axis=1)
    want = {}
    for i in range(0, n, every):
        sims = sorted((-(round(float(v[i] @ v[j] / (norm[i] * norm[j])) if norm[i] * norm[j] else 0.0, 6) + 0.0), j) for j in range(n) if j != i)[:5]
        want.update({(i, k + 1): (j, -s) for k, (s, j) in enumerate(sims)})
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


# 6 token counts


def greedy(word: str, inner: set[str], last: set[str]) -> int:
    """The longest piece from the left, again and again: one of ``last`` if it reaches the end, else one of ``inner``; 1 if that fails."""
    n = at = 0
    while at < len(word):
        if word[at:] in last:
            return n + 1
        step = next((k for k in range(len(word) - at - 1, 0, -1) if word[at : at + k] in inner), 0)
        if not step:
            return 1
        at, n = at + step, n + 1
    return n


def test_automaton_counts_the_longest_pieces():
    rng = random.Random(6)
    for _ in range(40):
        inner, last = ({"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(m)} for m in (15, 10))
        if rng.random() < 0.7:
            inner, last = inner | set("abc"), last | set("abc")
        a = token_counts.Automaton(sorted([tuple(p.encode()) for p in inner] + [token_counts.symbols_of(p.encode()) for p in last]))
        for _ in range(200):
            word = "".join(rng.choices("abc", k=rng.randrange(1, 14)))
            assert a.count(word.encode()) == greedy(word, inner, last), (word, inner, last)


def test_token_counts_with_the_public_vocabulary(spark):
    texts = [(0, "Hello, world! It's 2024."), (1, "naïve café 漢字 antidisestablishmentarianism"), (2, "a" * 300 + " __ ok"), (3, "outre rele"), (4, None)]
    with open(token_counts.VOCABULARY, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    last, inner = {p[:-4] for p in vocabulary if p.endswith("</w>")}, {p for p in vocabulary if not p.endswith("</w>")}
    char = {b: c for c, b in token_counts._byte_of_char().items()}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(table(spark, texts)).collect()}
    for i, text in texts[:-1]:
        words = ["".join(char[b] for b in w.encode()) for w in token_counts.WORD.findall(text.lower())]
        assert got[i] == (len(words), sum(greedy(w, inner, last) for w in words))
    assert got[3] == (2, 4) and got[4] == (None, None)


def test_no_word_is_unknown_to_the_public_vocabulary():
    pieces = set(token_counts.read_vocabulary())
    assert all((b,) in pieces and (b + token_counts.LAST,) in pieces for b in range(256) if bytes([b]).isascii() or b >= 0x80)


# 7 toxicity


def test_clauses_not_words_are_scored():
    s = toxicity.Scorer(())
    direct, bare = s.score("You are an idiot.")[0], s.score("The idiot.")[0]
    assert direct > bare > s.score("You are not an idiot.")[0]
    assert direct > s.score("She said you are an idiot.")[0]
    assert s.score("I will kill you.")[0] >= 1.5 and s.score("kill the process")[0] == 0
    assert s.score("A fine day for everyone.") == (0.0, 0)


@pytest.mark.parametrize(
    "text",
    ["The clown juggled.", "Take out the trash.", "The sensor readings were worthless.", "They kill time.", "He isn't an idiot.", "He isn’t an idiot.", "She said you are an idiot. " * 20, "You are not an idiot. " * 20, "They beat the deadline."],
)
def test_what_is_left_alone(text):
    assert toxicity.Scorer(()).score(text)[0] < 0.6


@pytest.mark.parametrize("text", ["You are an idiot.", "You're such a loser!", "I will kill you.", "Ich werde dich töten.", "Je vais t'abattre, tu es l'ordure.", "Tu es l’idiote, une connasse.", "Idiot, you!", "Those people are vermin."])
def test_what_is_toxic(text):
    assert toxicity.Scorer(()).score(text)[0] >= 0.6


def test_a_score_does_not_grow_with_the_text():
    s = toxicity.Scorer((("grumble", 0.5),))
    assert s.score("A grumble here. " * 1000)[0] <= 1.5 * s.score("A grumble here. ")[0] + 1e-6


def test_composed_machine_multiplies_its_parts():
    rng = random.Random(7)
    whole, parts = toxicity.grammar(), toxicity.parts()
    for _ in range(200):
        state, states = whole.start, [p.start for p in parts]
        for _ in range(30):
            c = rng.choice(list(toxicity.CLASSES))
            state, out = whole.step[state, c]
            moved = [p.move(s, c) for p, s in zip(parts, states)]
            states = [s for s, _ in moved]
            assert out == pytest.approx(np.prod([x for _, x in moved])) and state == tuple(states)


def test_trigger_passes_all_that_scores():
    stems = (("grumble", 0.5), ("snark", 0.9))
    s, trigger = toxicity.Scorer(stems), toxicity.trigger(stems)
    pattern = re.compile(re.sub(r"^\(\?iu\)", "", trigger).replace(r"[\p{L}]", r"[^\W\d_]").replace(r"\p{L}", r"[^\W\d_]"), re.I)
    for t in ["you grumblefax", "GRUMBLE.", "snarky you", "you idiot", "a moron!", "kill you", "skill you", "Tu es l’idiot", "d'abschaum du"]:
        if s.score(t)[0] > 0:
            assert pattern.search(t), t


def test_stems_are_learnt_from_labels(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        t = random_text(rng, 40)
        if i % 4 == 0:
            t[rng.randrange(40)] = "zorblax" + rng.choice(["", "es", "ing"])
        docs.append((i, " ".join(x.translate(str.maketrans("0123456789", "abcdefghij")) for x in t)))
        labels.append((i, int(i % 4 == 0)))
    d = table(spark, docs)
    seen = spark.createDataFrame(labels[:200], "doc_id long, toxic int")
    stems = toxicity.learnt_stems(d, seen)
    assert [s for s, _ in stems] == ["zorblax"]
    held_out = {i for i, y in labels[200:] if y}
    assert {r.doc_id for r in toxicity.toxic_documents(d, stems, 0.4).collect() if r.doc_id >= 200} == held_out
    assert toxicity.learnt_stems(d, seen.limit(0)) == ()


# 8 exact dedup


@pytest.mark.parametrize("counters", [1, 3, 256])
def test_exact_dedup(spark, counters):
    rng = random.Random(counters)
    rows = [(rng.randrange(3000), rng.choice(["hot", "hot", "warm", f"t{rng.randrange(40)}"])) for _ in range(1500)]
    got = {r.digest: (r.doc_id, r.n_copies) for r in heavy_dedup.kept_copies(table(spark, rows).repartition(6), counters).collect()}
    least, n = {}, Counter(t for _, t in rows)
    for i, t in rows:
        least[t] = min(i, least.get(t, i))
    assert sorted(got.values()) == sorted((least[t], n[t]) for t in n)


def test_misra_gries_names_every_heavy_hitter(spark):
    rng = random.Random(9)
    values = ["a"] * 300 + ["b"] * 200 + [f"r{rng.randrange(400)}" for _ in range(500)]
    rng.shuffle(values)
    found = heavy_dedup.misra_gries(spark.createDataFrame([(v,) for v in values], "v string").repartition(40), "v", 9)
    assert {"a", "b"} <= set(found) and len(found) <= 9


# 9 packing


def test_knapsack():
    rng = np.random.default_rng(9)
    for _ in range(20):
        prices, room = rng.random(5), int(rng.integers(1, 12))
        value, pattern = packing.knapsack(prices, room)
        best = max(sum(prices[s - 1] for s in c) for k in range(room + 1) for c in itertools.combinations_with_replacement(range(1, 6), k) if sum(c) <= room)
        assert value == pytest.approx(best) and pattern @ np.arange(1, 6) <= room and pattern @ prices == pytest.approx(value)


def test_patterns_hold_the_demand_near_the_bound():
    rng = np.random.default_rng(10)
    for _ in range(20):
        demand = rng.integers(0, 60, 16) * (rng.random(16) < 0.7)
        found, bound = packing.patterns(demand, 16)
        assert (sum((p * n for p, n in found), np.zeros(16, np.int64)) == demand).all()
        assert all(p @ np.arange(1, 17) <= 16 for p, _ in found)
        assert bound - 1e-6 <= sum(n for _, n in found) <= bound + np.count_nonzero(demand)
        assert bound >= demand @ np.arange(1, 17) / 16 - 1e-6


def test_every_token_is_packed_once(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.8) * 10))) for i in range(800)]
    got = packing.packed_sequences(table(spark, rows), 128, 32).collect()
    at = defaultdict(list)
    full = Counter()
    for r in got:
        at[r.doc_id].append((r.doc_start, r.doc_start + r.n_tokens))
        full[r.sequence] += r.n_tokens
    assert max(full.values()) <= 128
    for i, text in rows:
        pieces = sorted(at[i])
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text.split()) and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    assert len(full) <= 1.05 * sum(full.values()) / 128 + 32


@pytest.mark.parametrize(("capacity", "steps"), [(2050, 64), (32, 64), (100, 7), (1, 1), (5, 3)])
def test_any_capacity(spark, capacity, steps):
    rng = random.Random(capacity)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 3 * capacity + 2))) for i in range(100)]
    full, at = Counter(), defaultdict(list)
    for r in packing.packed_sequences(table(spark, rows), capacity, steps).collect():
        full[r.sequence] += r.n_tokens
        at[r.doc_id].append((r.doc_start, r.doc_start + r.n_tokens))
    assert max(full.values()) <= capacity
    for i, text in rows:
        pieces = sorted(at[i])
        assert [a for a, _ in pieces] == [0, *(b for _, b in pieces)][: len(pieces)] and (pieces[-1][1] if pieces else 0) == len(text.split())


# 10 n-gram Jaccard join


def gram_set(text: str, n: int = 3) -> frozenset:
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def all_similar(rows, threshold=0.5) -> dict[tuple[int, int], float]:
    sets = [(i, gram_set(t)) for i, t in rows]
    return {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and len(x & y) / len(x | y) >= threshold}


def classes_of(ids, pairs) -> dict[int, int]:
    """The least of all that hang together with each."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("bucket", "block"), [(1000, 2048), (4, 2048), (16, 5)])
def test_similar_classes(spark, bucket, block):
    rows = corpus(12, 300)
    rows += [(1000 + i, rows[7][1]) for i in range(5)] + [(2000 + i, rows[9][1] + " end") for i in range(4)]
    want = all_similar(rows)
    links = Counter(x for p in want for x in p)
    found = chosen_path.similar_classes(table(spark, rows), bucket=bucket, block=block).collect()
    got = {r.doc_id: r for r in found}
    assert len(got) == len(found) and set(got) <= set(links)
    assert all(r.n_links <= links[i] for i, r in got.items())
    assert sum(r.n_links for r in found) >= 0.95 * sum(links.values()) > 100
    wanted = classes_of([i for i, _ in rows], want)
    assert all(wanted[r.class_id] == wanted[i] for i, r in got.items())
    assert sum(r.class_id == wanted[i] for i, r in got.items()) >= 0.9 * len(links)
    assert {got[i].class_id for i in range(1000, 1005)} == {got[7].class_id}


def near_copies(n: int, changed: int = 6) -> list[tuple[int, str]]:
    rng = random.Random(21)
    base = [f"z{i}" for i in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(changed):
            t[rng.randrange(len(t))] = f"y{rng.randrange(10**6)}"
        out.append((5000 + i, " ".join(t)))
    return out


@pytest.mark.parametrize("block", [2048, 50])
def test_a_large_cluster_of_near_copies(spark, block):
    rows = corpus(16, 60) + near_copies(200)
    want = all_similar(rows)
    links = Counter(x for p in want for x in p)
    found = {r.doc_id: r for r in chosen_path.similar_classes(table(spark, rows), bucket=50, block=block).collect()}
    assert all(r.n_links <= links[i] for i, r in found.items())
    assert sum(r.n_links for r in found.values()) >= 0.95 * sum(links.values())
    assert {found[i].class_id for i, _ in rows if i >= 5000} == {5000}
    kept = [r.doc_id for r in chosen_path.one_of_each_group(table(spark, rows), bucket=50, block=block).collect()]
    classes = classes_of([i for i, _ in rows], want)
    assert set(classes.values()) <= set(kept) and len(kept) == len(set(kept)) <= len(set(classes.values())) + 3


@pytest.mark.parametrize("size", [1, 7, 100])
@pytest.mark.parametrize("least", [1, 12, 1000])
def test_units_stay_whole_over_many_batches(size, least):
    rng = random.Random(23)
    rows = sorted((rng.randrange(25), 0, rng.randrange(3), f"{i}" * (i % 3)) for i in range(150))
    schema = pa.schema([("path", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("grams", pa.binary()), ("paths", pa.list_(pa.int64()))])
    batches = (pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*zip(*part), [[r[0]] for r in part]), schema)], schema=schema) for part in itertools.batched(rows, size))
    got = []
    for b, at in chosen_path._units(batches, least):
        assert at[0] == 0 and at[-1] == b.num_rows
        t = [tuple(r[c] for c in ("path", "lo", "hi", "grams", "paths")) for r in b.to_pylist()]
        got += [t[i:j] for i, j in itertools.pairwise(at)]
    want = [[(*r[:3], r[3].encode(), [r[0]]) for r in g] for _, g in itertools.groupby(rows, lambda r: r[:3])]
    assert got == want


@pytest.mark.parametrize("rows, often, rare", [(300, 3, 400), (300, 80, 100), (200, 0, 5)])
def test_pairs_belong_to_their_least_bucket(rows, often, rare):
    rng = random.Random(24)
    lists = [sorted({100, *(p for p in range(100 - often, 100) if rng.random() < 0.2), *(rng.randrange(-rare, 0) for _ in range(3)), rng.randrange(101, 110)}) for _ in range(rows)]
    paths = chosen_path._Paths(pa.array(lists, type=pa.list_(pa.int64())), np.full(rows, 100))
    i, j = np.triu_indices(rows, 1)
    below = [{p for p in x if p < 100} for x in lists]
    want = [below[a].isdisjoint(below[b]) for a, b in zip(i, j)]
    assert paths.owned(i, j).tolist() == want and 0 < sum(want) < len(want)
    assert paths.owned(i[:50], j[:50]).tolist() == want[:50]


def test_pairs_of_large_buckets_do_not_compare_their_lists():
    rows = 4000
    paths = chosen_path._Paths(pa.array([list(range(27))] * rows, type=pa.list_(pa.int64())), np.full(rows, 26))
    i, j = np.triu_indices(rows, 1)
    began = time.process_time()
    assert not paths.owned(i, j).any()
    assert time.process_time() - began < 2


def test_similar_classes_of_many_batches_in_a_task(spark):
    rows = []
    for i in range(1500):
        words = [f"a{i}x{j}" for j in range(12)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "end"]))]
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "300"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = chosen_path.similar_classes(table(spark, rows)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all((r.class_id, r.n_links) == (r.doc_id // 2 * 2, 1) for r in found)
    assert len({r.doc_id for r in found}) == len(found) >= 0.98 * len(rows)


def test_recall_of_pairs_near_the_threshold(spark):
    rng = random.Random(22)
    rows = []
    for i in range(400):
        a, k = [f"a{i}x{j}" for j in range(60)], rng.randrange(32, 36)
        b = a[:k] + [f"b{i}x{j}" for j in range(4)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    want = {(2 * i, 2 * i + 1) for i in range(400) if len((x := gram_set(rows[2 * i][1])) & (y := gram_set(rows[2 * i + 1][1]))) >= 0.5 * len(x | y)}
    got = {r.doc_id for r in chosen_path.similar_classes(table(spark, rows)).collect()}
    assert len(want) > 50 and got <= {i for p in want for i in p} and len(got) / 2 >= 0.95 * len(want)


def test_rows_that_share_a_doc_id(spark):
    rng = random.Random(15)
    x, y, z = (" ".join(random_text(rng, 40)) for _ in range(3))
    rows = [(1, x), (1, y), (2, x), (3, y + " end"), (4, y), (5, z), (1, x), (4, x)]
    found = chosen_path.similar_classes(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == [(1, 1, 2), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 2), (4, 1, 2), (4, 1, 3)]
    kept = sorted((r.doc_id, r.text) for r in chosen_path.one_of_each_group(table(spark, rows)).collect())
    assert kept == sorted([(1, x), (1, y), (5, z)])


def test_ids_may_be_strings(spark):
    text = " ".join(random_text(random.Random(3), 40))
    docs = spark.createDataFrame([("b", text), ("a", text + " end"), ("c", "other words altogether")], "doc_id string, text string")
    assert sorted(tuple(r) for r in chosen_path.similar_classes(docs).collect()) == [("a", "a", 1), ("b", "a", 1)]
    assert sorted(r.doc_id for r in chosen_path.one_of_each_group(docs).collect()) == ["a", "c"]


def test_components_are_connected(spark):
    rng = random.Random(13)
    pairs = [(a, a + rng.randrange(1, 4)) for a in range(0, 200, 2) if rng.random() < 0.8] + [(i, i + 1) for i in range(500, 560)]
    want = classes_of({x for p in pairs for x in p}, pairs)
    got = {r.u: r.v for r in chosen_path.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: r for x, r in want.items() if r != x}
