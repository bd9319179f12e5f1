"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and
extra columns with clashing names, against a plain restatement."""

import hashlib
import re
import time
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heatlens.llm import ego_join, exact_dedup, language, lexicon_bpe, near_dedup, packing, pii, token_files, toxicity, url_filter
from heatlens.llm.components import components
from heatlens.llm.queries import BYTE_BPE, ORACLE, QUERIES, WORD_BPE
from heatlens.llm.tokens import ByteBpe
from heatlens.llm.transducers import best_path
from heatlens.staging import staging_path

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [
    (0, None), (1, ""), (2, " \t\n"), (3, "One two\tthree  four five six"), (4, "One two three four five six"),
    (5, LONG), (6, LONG), (7, "a@b.c-d_e@f.g and 1.2.3.4.5 +49 (30) 1234567 4111 1111 1111 1111"), (7, "a repeated id"),
    (None, "no id"), (8, "<|endoftext|> ünï ½ 日本 'S"), (9, "3 . ! ?"), (4, "One two three four five six"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, n_shingles string, part int")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, data_dir, name):
    assert difference(spark, QUERIES[name], ORACLE[name], data_dir) is None


def test_exact_dedup(docs):
    want = defaultdict(list)
    for i, t in TEXTS:
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = exact_dedup.duplicate_report(docs).collect()
    assert len(got) == len(TEXTS)
    keep = {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == keep[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(want)
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


def brute_near(rows):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, top = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        top[i] = i
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = {k: low if v == high else v for k, v in top.items()}
    return {i: (len(sets[i]), top[i]) for i in sets}


def test_near_dedup(spark):
    random = np.random.default_rng(3)
    base = [f"w{x}" for x in random.integers(0, 500, 120)]
    rows = list(enumerate([None, "", "Few words", "few\nWORDS", LONG, LONG + "more"]))
    for i in range(60):  # a chain of ever larger changes, so that some fail against the first
        words = list(base)
        for at in random.integers(0, 120, i % 12):
            words[at] = f"x{i}"
        rows.append((100 + i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_odd_rows(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    left = near_dedup.keep_one_of_each(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {None, 0, 1, 2, 3, 5, 7, 8, 9}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 55: 50, 60: 50}


def test_ego_join(spark):
    random = np.random.default_rng(5)
    points = random.normal(size=(40, 8))
    rows = [(i, (points[i % 40] + random.normal(size=8) * (0.1 if i % 3 else 0)).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, []), (None, points[0].tolist()), (1004, [1.0, 2.0])]
    odd = [(2000, [None, 1.0])]
    got = {r.vec_id: r for r in ego_join.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for i, v in rows[:300]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    top = np.arange(300)
    for _ in range(300):
        new = np.array([top[linked[i]].min() for i in range(300)])
        if (new == top).all():
            break
        top = new
    for i in range(300):
        assert (got[i].n_links, got[i].component_id) == (linked[i].sum() - 1, top[i])
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 2000))


def brute_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn)
                or (kind == "phone" and 8 <= len(digits) <= 15)
            ):
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, docs):
    hard = ["a@b.c%d@e.f", "1.2.3.256.1.1.1.1", "+1 (555) 555-1234 tel 555 123-4567", "𝒳 4111-1111-1111-1111", "a" * 30000, "1 " * 20000, "@@a@b.c@d.e"]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(hard, 100)), "doc_id long, text string"))
    for r in pii.find_spans(more, "doc_id", "text").collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == brute_spans(r.text or "")
    masked = {r.doc_id: r.text for r in pii.mask(docs.filter("text like '%@%' or text is null")).collect()}
    assert masked[0] is None and "@" not in masked[7] and "[email]" in masked[7]
    assert pii.mask(docs).columns == docs.columns and pii.mask(docs).count() == len(TEXTS)
    assert pii.find_spans(docs.limit(0), "doc_id").count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/a?x#y", "http://a.example.com/en/", "http://x.net/fr/1", "http://x.net/de/", "https://com", "x://org/", "://", "http://x.com?/en/"]
    pages = spark.createDataFrame([(i % 9, u, "z") for i, u in enumerate(urls + urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/fr/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = {(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert ("www.example.com", "/en/a", "www.example.com/en/", "allow") in got and ("a.example.com", "/en/", "example.com/en/", "block") in got
    assert ("x.net", "/fr/1", "net/fr/", "block") in got and ("x.net", "/de/", None, "allow") in got and ("com", "", None, "allow") in got
    assert url_filter.judge(pages, rules).count() == len(urls) * 2 and url_filter.judge(pages, rules.limit(0)).count() == len(urls) * 2


def test_mask_takes_long_values_whole(spark):
    key, name = "Ab1-_" * 200, "n4me" * 30
    texts = [
        *[f"login user password={'x1' * n} end" for n in range(4, 24)],
        f"aws api_key={key} end", f"access token={key}, end", f"user key AKIA{'Z9' * 100} end", f"write to {name} [at] example (dot) com end",
        f"access token={key}+4111111111111111&to=a@b.com&{key} end",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask(rows).collect()}
    assert [got[n] for n in range(20, 24)] == ["aws [secret] end", "access [secret], end", "user key [secret] end", "write to [email] end"]
    assert got[24] == "access [secret] end"


def masked_by(text, spans):
    out, pos = [], 0
    for s in sorted(spans, key=lambda s: (s.start, s.end, s.kind)):
        if s.start >= pos:
            out.append(text[pos : s.start] + f"[{s.kind}]")
        pos = max(pos, s.end)
    return "".join(out) + text[pos:]


def many_spans(n):
    line = "𝒳 user{0}@host.example.com from 10.0.{1}.7 call 555-123-{0:04d} token=ab{0}@x.org+49 30 {0}1234567 card 4111 1111 1111 1111, a (at) b.org\n"
    return "".join(line.format(i % 10000, i % 256) for i in range(n)) + "é" * 9000 + " end@of.text " + "z" * 5000


def test_time_of_a_text_follows_its_spans(spark):
    """Spans and masks of texts of thousands of spans are those of plain loops, in time that does not follow their square."""
    took = {}
    for n in (400, 2000, 8000):
        rows = spark.createDataFrame([(1, many_spans(n)), (2, None), (3, "a@b.c" * 5000)], "doc_id long, text string")
        begun = time.time()
        found = {r.doc_id: r for r in pii.find_spans(rows, "doc_id", "text").collect()}
        masked = {r.doc_id: r.text for r in pii.mask(rows).collect()}
        took[n] = time.time() - begun
        for i in (1, 3):
            r = found[i]
            base = [s for s in r.spans if s.base]
            assert [(s.kind, s.start, s.end) for s in base] == brute_spans(r.text) and len(base) > (3 * n if i == 1 else 0)
            assert masked[i] == masked_by(r.text, r.spans)
            taken = {at for s in base for at in range(s.start, s.end)}
            assert not any(taken & set(range(s.start, s.end)) for s in r.spans if not s.base and s.kind != "secret")
        assert masked[2] is None and any(s.kind == "secret" for s in found[1].spans)
    assert took[8000] < 5 * took[2000]


def test_spans_apart(spark):
    """Wider spans stay if they touch no base span, whatever the order and overlaps."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        spans = [(int(a), int(a + rng.integers(1, 9)), "email" if rng.random() < 0.9 else "secret", "v", "b") for a in rng.integers(0, 60, rng.integers(0, 14))]
        cut = rng.integers(0, len(spans) + 1)
        rows.append((i, [(a, b, k, True, v, w) for a, b, k, v, w in spans[:cut]], [(a, b, k, False, v, w) for a, b, k, v, w in spans[cut:]]))
    table = spark.createDataFrame(rows, f"id int, base array<{pii.SPAN}>, wider array<{pii.SPAN}>")
    got = {r.id: r.spans for r in table.select("id", pii._apart(F.col("base"), F.col("wider")).alias("spans")).collect()}
    for i, base, wider in rows:
        stay = [s for s in wider if s[2] == "secret" or not any(b[0] < s[1] and s[0] < b[1] for b in base)]
        assert sorted(map(tuple, got[i])) == sorted(base + stay)


def test_token_files(spark, docs):
    exact, path = Tokenizer.from_file(BYTE_BPE), staging_path(spark, "test-tokens")
    token_files.write_token_files(docs, path, BYTE_BPE, 2)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    total = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == total and any(i == r.doc_id and exact.encode(t or "", add_special_tokens=False).ids + [2] == ids for i, t in TEXTS)
        total += len(ids)
    assert {r.doc_id for r in token_files.read_documents(spark, path, [5, 8, 77]).collect()} == {5, 8}
    empty = staging_path(spark, "test-tokens")
    token_files.write_token_files(docs.limit(0), empty, BYTE_BPE, 2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_packing(docs):
    exact = Tokenizer.from_file(BYTE_BPE)
    rows, used = packing.pack(docs, BYTE_BPE, 1).collect(), defaultdict(list)
    want = sum(len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    assert sum(r.length for r in rows) == want and sorted(used) == list(range(len(used)))
    for places in used.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 2048
    assert packing.pack(docs.limit(0), BYTE_BPE, 1).count() == 0


def test_plan_covers_the_histogram():
    histogram = {64 * k: 37 * k % 50 for k in range(1, 32)} | {k: 11 * k % 23 for k in range(1, 64)} | {2048: 5}
    plan = packing.solve(histogram, 2048)
    made = defaultdict(int)
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 2048
        for s, n in pattern.items():
            made[s] += n * times
    assert made == {s: n for s, n in histogram.items() if n}
    tokens = sum(s * n for s, n in histogram.items())
    assert sum(t for _, t in plan) <= tokens / 2048 * 1.05 + 2


def test_lexicon(docs):
    exact = Tokenizer.from_file(WORD_BPE)
    for r in lexicon_bpe.encode(docs, WORD_BPE).collect():
        options = [exact.encode(t or "", add_special_tokens=False).ids for i, t in TEXTS if i == r.doc_id]
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in options and r.decoded == exact.decode(ids, skip_special_tokens=False)
    assert lexicon_bpe.encode(docs.limit(0), WORD_BPE).count() == 0


def test_lexicon_file(tmp_path):
    words = sorted({f"{a}{b}ing".encode() for a in "abcdef" for b in ("", "r", "st")} | {b"a", b"ab"})
    path = tmp_path / "lexicon.bin"
    path.write_bytes(lexicon_bpe.compile_lexicon((w, [i, 7 * i]) for i, w in enumerate(words)))
    lexicon = lexicon_bpe.Lexicon(str(path))
    assert all(np.frombuffer(lexicon.get(w), "<u4").tolist() == [i, 7 * i] for i, w in enumerate(words))
    assert lexicon.get(b"zing") is None and lexicon.get(b"") is None and lexicon.get(b"arin") is None


def test_byte_bpe_equals_the_library():
    bpe = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for _, text in TEXTS:
        assert bpe.ids(text or "").tolist() == bpe.exact.encode(text or "", add_special_tokens=False).ids


def test_language(spark, docs, data_dir):
    table = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = QUERIES["op3_language_id"](spark, data_dir).join(table.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.9 * got.count()
    model = language.train(table.filter("doc_id % 2 = 0 and lang is not null"))
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[9] == ("und", 0.0) and odd[5][0] in model.labels
    none = language.train(table.select("doc_id", "text", "lang").limit(0))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_toxicity(spark, docs):
    rows = [(i, f"word{i % 17} is a {'zonk' if i % 4 == 0 else 'fine'} thing, you {'blarg' if i % 4 == 0 else 'good'} one{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(texts, labels)
    got = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    odd = toxicity.score(docs, model, "__p")
    assert odd.columns == [*docs.columns, "__p"] and odd.filter("__p < 0 or __p > 1 or __p is null").count() == 0
    assert toxicity.score(docs, toxicity.train(texts, labels.limit(0))).agg(F.max("score")).first()[0] == 0


def test_grammar_composes_the_transducers():
    grammar = toxicity.Grammar({"zonk": 2.0, "blar*": 1.0})
    kinds = lambda text: [k for _, k, _ in grammar.matches(text.split())]
    assert kinds("a zonk") == ["plain"] and kinds("you zonk blargish") == ["targeted", "targeted"]
    assert kinds("not a zonk") == ["negated"] and kinds("he said zonk") == ["reported"] and kinds("kill you kill") == ["threat"]


@pytest.mark.parametrize("verb_first, target_first, insult_first", [
    ("i will kill you", "you i will kill", "zonk, you"),
    ("ich werde töten dich", "ich werde dich töten", "zonk, du"),
    ("je vais frapper toi", "toi je vais frapper", "zonk, toi"),
    ("voy a matar ella", "te voy a matar", "zonk, tu"),
])
def test_a_target_completes_a_match_in_either_order(verb_first, target_first, insult_first):
    grammar = toxicity.Grammar({"zonk": 2.0})
    kinds = lambda text: [k for _, k, _ in grammar.matches(toxicity.WORD.findall(text))]
    assert kinds(verb_first) == kinds(target_first) == ["threat"] and kinds(insult_first) == ["targeted"]
    assert kinds(verb_first.rsplit(" ", 1)[0]) == [] and kinds("not " + insult_first) == ["negated"]
    assert grammar.features(verb_first).any() and not grammar.features("kill the lamp. you").any()


def test_the_composed_machine_equals_its_parts():
    """On random clauses: the machines run one after another, every path of each followed."""
    rng = np.random.default_rng(5)
    parts = toxicity.clause_machines()

    def one_after_another(symbols):
        inputs = [(tuple(symbols), (1.0,) * len(symbols))]
        for part in parts:
            written = []
            for word, shares in inputs:
                paths = [(s, (), ()) for s in part.starts]
                for symbol, share in zip(word, shares):
                    paths = [(to, w + (out,), h + (share * p,)) for s, w, h in paths for to, out, p in part.arcs.get((s, symbol), ())]
                written += [(w, h) for s, w, h in paths if s in part.finals]
            inputs = written
        return inputs

    for _ in range(300):
        symbols = rng.integers(0, 32, rng.integers(0, 12)).tolist()
        weights = rng.random(len(symbols)).tolist()
        (word, shares), = one_after_another(symbols)
        want = [(i, out, pytest.approx(share * w)) for i, (out, share, w) in enumerate(zip(word, shares, weights)) if out]
        total, got = best_path(toxicity.CLAUSE_MACHINE, symbols, weights)
        assert got == want and total == pytest.approx(sum(x[2] for x in got))


def test_negated_and_reported_insults_score_below_plain_ones(spark):
    """Also where no training row has any of them: the priors hold there."""
    rows = [(i, f"word{i % 17} thing number{i} " + ("is an idiot here" if i % 4 == 0 else "is fine here")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert "idiot" in model.grammar.arcs
    score, clean = model.score, model.score("a fine thing")
    assert clean < score("he is not idiot") < score("what idiot") > score("he said idiot") > clean
    assert score("you idiot") >= score("what idiot") > 0.5 > score("he is not idiot") and score("i will kill you") > clean
    assert score("i will not kill you") == score("i will kill the lamp") == clean == score(None) == score("")
    assert toxicity.prior_weights()[toxicity.SHARED : toxicity.WIDTH : 2].all()


def test_every_significant_form_is_an_arc(spark):
    """Near copies of one long toxic text hold more forms than any list of best forms had places."""
    letters = "abcdefghij"
    many = " ".join("".join(letters[int(d)] for d in f"{n:04d}") for n in range(5000))
    rows = [(n % 5, f"{many} {'x' * (n + 5)}", 1) for n in range(60)]
    rows += [(n % 5, f"zonk {'y' * (n + 5)}", 1) for n in range(40)] + [(n % 5, f"fine {'z' * (n + 5)}", 0) for n in range(100)]
    arcs = toxicity.learn_arcs(spark.createDataFrame(rows, "fold int, text string, toxic int"))
    assert all("zonk" in a and "aaab" in a and len(a) >= 5000 and "fine" not in a for a in arcs)


def test_a_form_beyond_chance_needs_no_majority(spark):
    """A word that 45 % of whose rows are toxic, where 11 % of all rows are."""
    toxic = [(n % 5, f"{'zonk' if n < 90 else 'other'} {'y' * (n + 5)}", 1) for n in range(110)]
    clean = [(n % 5, f"{'zonk' if n < 110 else 'fine'} {'z' * (n + 5)}", 0) for n in range(890)]
    arcs = toxicity.learn_arcs(spark.createDataFrame(toxic + clean, "fold int, text string, toxic int"))
    assert all(a["zonk"] > 0 and "fine" not in a for a in arcs)


def test_fit_sample_has_a_text_once(spark):
    """A text that is a third of the rows is one row of the sample, at its weight; a rare one keeps its chance."""
    rows = [(0, 5 << 18, "copied", 1)] * 2000 + [(n % 5, ((2 * n + 1) * 5 << 20) // 8000, f"text {n}", n % 2) for n in range(4000)]
    table = spark.createDataFrame(rows, "fold int, place long, text string, toxic int")
    got = toxicity.fit_sample(table, 0.1).collect()
    assert [r.weight for r in got if r.text == "copied"] == [pytest.approx(200)]
    assert len(got) == 401 and {r.weight for r in got if r.text != "copied"} == {1.0}
    assert sum(r.weight for r in toxicity.fit_sample(table, 1.0).collect()) == 6000


def test_pipeline(spark, data_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns, exact, kept = docs.columns, Tokenizer.from_file(BYTE_BPE), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, data_dir), "test")
        assert docs.columns == columns
        if name == "near dedup":
            kept = docs.collect()
    near = brute_near([(r.doc_id, r.text) for r in kept])
    assert all(low == i for i, (_, low) in near.items())
    texts = docs.collect()
    assert len(texts) == len(kept) and not any(brute_spans(r.text or "") for r in texts)
    want = sorted((r.doc_id, len(exact.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in texts)
    got = corpus_pipeline.pack_sequences(spark, docs, data_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(i, n) for i, n in want]


def test_remembered_words_change_no_match(monkeypatch):
    monkeypatch.setattr(toxicity, "PLAIN_WORDS", 5)
    texts = ["You idiot, idiots! Not an idiot. " + f"w{'abcdefgh'[i % 8]} stop" * (i % 9) + " I will kill you" * (i % 2) for i in range(60)]
    used = toxicity.Grammar({"idiot": 2.0, "idio*": 1.0, "stop": 0.5})
    for text in [*texts, "x" * 100_000, "", None]:
        fresh = toxicity.Grammar(used.arcs)
        assert used.features(text).tolist() == fresh.features(text).tolist()
        assert len(used.plain) <= 5 + 20 and all(len(w) <= toxicity.PLAIN_LENGTH for w in used.plain)
