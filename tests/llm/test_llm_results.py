"""Operators against brute force, exact round trips or held-out accuracy on small tables."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from xxhash import xxh3_64_intdigest

from fleetspark.llm import brown, chat, minhash
from fleetspark.llm.base import rolling
from fleetspark.llm.graph import components
from fleetspark.llm.base import Scratch
from fleetspark.llm.exact import exact_duplicates
from fleetspark.llm.lines import line_rules, viterbi
from fleetspark.llm.packing import cut
from fleetspark.llm.queries import ORACLES, QUERIES, tokenizer_file
from fleetspark.llm.spiece import Coder, decoded, encoded
from fleetspark.llm.substring import repeated_runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = [tuple(r[c] for c in want.columns) for r in QUERIES[name](spark, SF).collect()]
    rows = want.fetchall()
    assert len(rows) and sorted(map(str, got)) == sorted(map(str, rows))


@pytest.mark.parametrize("hot", [0, 5_000])
def test_repeated_runs_by_brute_force(spark, texts, hot):
    length = 12
    split = {i: t.encode().split() for i, t in texts.items()}
    seen = collections.Counter(tuple(w[p : p + length]) for w in split.values() for p in range(len(w) - length + 1))
    rows = repeated_runs(spark.read.parquet(f"{SF}/documents.parquet"), length=length, hot=hot).collect()
    assert len(rows) == len(texts) and any(0 < r["n_removed"] < r["n_words"] for r in rows)
    for r in rows:
        w = split[r["doc_id"]]
        gone = {q for p in range(len(w) - length + 1) if seen[tuple(w[p : p + length])] > 1 for q in range(p, p + length)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r["n_removed"], r["kept_sha256"]) == (len(gone), hashlib.sha256(kept).hexdigest())


def test_rolling_tells_runs_apart():
    h = np.array([3, 1, 4, 3, 1, 4, 1, 5], np.uint64)
    for size in (1, 2, 3, 5):
        runs = [tuple(h[i : i + size]) for i in range(len(h) - size + 1)]
        got = rolling(h, size)
        assert [[a == b for b in runs] for a in runs] == [[a == b for b in got] for a in got]


def test_near_classes_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    family = [rng.choice(vocabulary) for _ in range(200)]
    rows = []
    for i in range(120):
        if i % 2:
            text = list(family)
            for _ in range(rng.randrange(0, 9)):
                text[rng.randrange(200)] = rng.choice(vocabulary)
        else:
            text = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))] + family[: 60 * (i % 3)]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    common, scale = minhash.word_scale(docs.withColumnRenamed("doc_id", "id"))
    shingles = {i: minhash.shingle_weights(t.encode().split(), common, scale) for i, t in rows}
    root = {i: i for i in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(shingles, 2):
        if minhash.weighted_jaccard(shingles[a], shingles[b]) >= minhash.SIMILARITY:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in shingles} and len(set(got.values())) < 120


def test_samples_collide_as_often_as_texts_are_similar():
    sampler = minhash.Sampler(600)
    rng = np.random.default_rng(1)
    s = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    w = rng.uniform(1, 4, 300)
    v = w * rng.choice([1, 2], 300)
    want = minhash.weighted_jaccard((s[:250], w[:250]), (s[50:], v[50:]))
    assert abs((sampler(s[:250], w[:250]) == sampler(s[50:], v[50:])).mean() - want) < 0.07


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(frame, Scratch(spark, "test"), "g").collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op3_quality_classifier"](spark, sf).collect()}
    truth = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(rows[i]["predicted"], q) for i, q in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_blocks_tell_texts_apart(spark):
    rows = [(i, t) for i, t in enumerate(["ab" * 50, "ab" * 49 + "ba", "ab" * 50, "ba" * 50, "a", "", None, "ab" * 50 + " "])]
    got = {r["doc_id"]: r["keep_id"] for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=3).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_class_scores_by_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 5000)
    monkeypatch.setattr(brown, "CORE", 40)
    models, fit = [], brown.fit
    monkeypatch.setattr(brown, "fit", lambda *given: models.append(fit(*given)) or models[0])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*brown.lowered(t), None])
    n, v = sum(counts.values()), len(counts)
    rows = brown.class_scores(docs).collect()
    for r in rows:
        tokens = [*brown.lowered(texts[r["doc_id"]]), None]
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
    # the score again from the classes alone
    vocabulary, classes, _, _ = models[0]
    number = {int(h): i + 1 for i, h in enumerate(vocabulary.words)}
    at = {t: 0 if t is None else number.get(xxh3_64_intdigest(t), len(number) + 1) for t in {t for x in texts.values() for t in [*brown.lowered(x), None]}}
    often = {t for t in counts if t is not None and counts[t] * 5000 >= n}
    assert {t for t in counts if 0 < at[t] <= len(number)} == often and len(often) > 40
    moved = {classes[at[t]] for t in often}
    assert classes[0] == 0 and classes[-1] == brown.CLASSES - 1 and not {0, brown.CLASSES - 1} & moved and len(moved) > 5
    steps, before, inside = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            chain = [0, *(classes[at[w]] for w in [*brown.lowered(t), None])]
            steps.update(zip(chain, chain[1:]))
    for (a, b), m in steps.items():
        before[a] += m
        inside[b] += m
    shares = [(inside[c] + 1) / (n + brown.CLASSES) for c in range(brown.CLASSES)]
    mass = collections.Counter()
    for t in often:
        mass[classes[at[t]]] += counts[t] + 0.5
    seldom = [m for t, m in counts.items() if t is not None and t not in often]
    for r in rows[::7]:
        total, last = 0.0, 0
        for t in [*brown.lowered(texts[r["doc_id"]]), None]:
            c = classes[at[t]]
            total += math.log10((steps[last, c] + 5 * shares[c]) / (before[last] + 5))
            if t in often:
                total += math.log10((counts[t] + 0.5) / mass[c])
            elif t is not None:
                total += math.log10((counts[t] + 1) / (sum(seldom) + len(seldom) + 1))
            last = c
        assert r["score"] == pytest.approx(total)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_transitions_are_probabilities():
    table = np.random.default_rng(2).integers(0, 9, (6, 6)).astype(float)
    assert np.allclose((10 ** brown.transition_scores(table)).sum(axis=1), 1)


def test_exchange_finds_classes():
    rng = np.random.default_rng(4)
    true = np.r_[0, rng.integers(1, 4, 59), 4]
    likely = rng.random((5, 5)) ** 4
    pairs = rng.poisson(200 * likely[np.ix_(true, true)]).astype(float)
    own = brown.exchange(pairs, classes=5)
    assert own[0] == 0 and own[-1] == 4
    assert max(np.mean(np.array([0, *p, 4])[own] == true) for p in itertools.permutations((1, 2, 3))) > 0.95


def test_best_class_by_likelihood():
    """The chosen class is the one under which the whole table is likeliest."""
    rng = np.random.default_rng(8)
    k = 6
    table = rng.integers(40, 90, (k, k)).astype(float)
    own, owner, cell, n = np.array([2, 5]), np.array([0, 0, 0, 1, 1]), np.array([1, 3, k + 4, 2, k + 0]), np.array([9.0, 30, 25, 12, 31])
    got = brown.best_classes(own, owner, cell, n, table)
    phi = lambda x: (x * np.log(x)).sum()
    for w in range(2):
        likely = []
        for c in range(1, k - 1):
            moved = table.copy()
            for d, m in zip(cell[owner == w], n[owner == w]):
                for to, sign in ((own[w], -1), (c, 1)):
                    moved[(d, to) if d < k else (to, d - k)] += sign * m
            likely.append(phi(moved) - phi(moved.sum(0)) - phi(moved.sum(1)))
        assert got[w] == 1 + int(np.argmax(likely))


def test_line_counts_by_brute_force(spark, texts):
    rows = QUERIES["op8_quality_rules"](spark, SF).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        ws = text.encode().split()
        runs = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        again = {j for i in range(len(ws) - 7) if runs[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = text.split("\n")
        assert r["n_repeat_words"] == len(again) and r["n_words"] == len(ws)
        assert r["n_dup_lines"] == sum(bool(x.split()) and x in lines[:i] for i, x in enumerate(lines))
        assert r["word_chars"] == sum(len(w.decode()) for w in ws) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["base_failed"] == (len(ws) < 20 or 100 * len(again) > 30 * len(ws)) and not (r["kept"] and r["base_failed"])


def test_viterbi_by_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        e = [rng.gauss(0, 1) for _ in range(7)]
        step = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        score = lambda m: sum(x for x, y in zip(e, m) if y) + sum(step[a][b] for a, b in zip(m, m[1:]))
        assert score(viterbi(e, step)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=7))))


def test_clean_documents_pass_the_rules(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in line_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    good = [rows[i] for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall() if q]
    assert sum(r["kept"] or r["base_failed"] for r in good) / len(good) > 0.97


def _cheapest(roles):
    """Least cost over all legal sequences, by exhaustive search."""
    best = {chat.START: 0.0}
    for role in roles:
        ahead = {}
        for state, cost in best.items():
            for after in (chat.SYSTEM, chat.USER, chat.ASSISTANT):
                move = chat.MOVES[role][state][after]
                if move and cost + move[0] < ahead.get(after, math.inf):
                    ahead[after] = cost + move[0]
        best = ahead
    return min(c + chat.CLOSE_COST[s] for s, c in best.items())


def _legal(text):
    turns = [x.partition("\n")[0] for x in text.split("<|im_start|>")[1:]]
    body = turns[1:] if turns[0] == "system" else turns
    return len(body) % 2 == 0 and all(t == ("user", "assistant")[i % 2] for i, t in enumerate(body)) and text.count("<|im_end|>") == len(turns)


def test_chats_become_legal_at_least_cost(spark):
    rng = random.Random(9)
    turns, roles = [], {}
    for c in range(60):
        roles[c] = [rng.choice(["user", "assistant", "system", "GPT", None, "narrator"]) for _ in range(rng.randrange(1, 25))]
        turns += [(c, t, r, f"<|im_end|> {c} {t}") for t, r in enumerate(roles[c])]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for found in (chat.formatted_chats(frame).collect(), chat.formatted_chats(frame, run_turns=4, crowded=2).collect()):
        for c in roles:
            rows = sorted((r for r in found if r["conv_id"] == c), key=lambda r: r["position"])
            assert [r["turn"] for r in rows] == list(range(len(roles[c])))
            assert _legal("".join(r["fragment"] for r in rows))
            state, cost = chat.START, 0.0
            for r in rows:
                after = chat.NAMES.index(r["role_out"])
                cost += chat.MOVES[chat.role_number(r["role_in"])][state][after][0]
                state = after
            assert cost + chat.CLOSE_COST[state] == _cheapest([chat.role_number(x) for x in roles[c]])


def test_crowded_turn_numbers_are_cut(spark):
    turns = [(1, 0, "user", f"t{i}") for i in range(300)] + [(1, 1, "assistant", "x")]
    rows = chat.formatted_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), crowded=16).collect()
    assert sorted(r["position"] for r in rows) == list(range(301))
    assert sum(r["action"] == "merge" for r in rows) == 299 and max(r["position"] for r in rows if r["action"] == "keep") == 300


def test_page_languages(spark):
    rows = QUERIES["op6_language_id"](spark, SF).collect()
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/pages.parquet'").fetchall()[0][0]
    assert len(rows) == n and sum(r["lang"] == r["declared"] for r in rows) / n > 0.95


def test_pieces_equal_the_original_and_decode(spark, texts):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = encoded(docs, path, with_ids=True)
    for r in rows.collect():
        assert list(r["ids"]) == own.encode(texts[r["doc_id"]]) and r["parity"] and r["round_trip"]
    assert {r["doc_id"]: r["text"] for r in decoded(rows, path).collect()} == texts
    coder = Coder(path)
    for text in ["  two  spaces ", "\n\nlines\n", "▁mark", "é́ emoji 🙂 \x00", "", " ", "tab\tx"]:
        raw, same, back = next(coder.encode([text]))
        assert np.frombuffer(raw, "<u4").tolist() == own.encode(text) and same and back


def test_packing_keeps_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = QUERIES["op10_packing"](spark, SF).toPandas()
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in rows[rows.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    filled = rows.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and filled.sum() / (2048 * len(filled)) > 0.95


def test_cuts_add_up():
    for tokens in [*range(1, 3000), 123_457]:
        pieces = cut(tokens)
        assert sum(pieces) == tokens and min(pieces) > 0 and max(pieces) <= 2048


def crowd(rng, copies):
    """Copies of a few passages with up to three words changed in each."""
    rows = []
    for family in range(3):
        base = [f"f{family}w{rng.randrange(300)}" for _ in range(160)]
        for _ in range(copies):
            changed = list(base)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(changed))
    return list(enumerate(rows))


@pytest.mark.parametrize("cell", [4, minhash.CELL])
def test_crowded_cells_lose_no_link(spark, cell):
    rows = crowd(random.Random(5), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    common, scale = minhash.word_scale(docs.withColumnRenamed("doc_id", "id"))
    shingles = {i: minhash.shingle_weights(t.encode().split(), common, scale) for i, t in rows}
    want = list(range(len(rows)))
    for a, b in itertools.combinations(want, 2):
        if minhash.weighted_jaccard(shingles[a], shingles[b]) >= minhash.SIMILARITY:
            low, high = sorted((want[a], want[b]))
            want = [low if x == high else x for x in want]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, cell=cell).collect()}
    assert [got[i] for i, _ in rows] == want
    assert 3 <= len(set(want)) < len(rows) / 2


def test_a_cell_links_no_class_twice():
    rows = crowd(random.Random(6), 40)
    none = np.empty(0, np.uint64), np.empty(0)
    sets = [minhash.shingle_weights(t.encode().split(), *none) for _, t in rows]
    total = np.array([w.sum() for _, w in sets])
    order = np.argsort(total, kind="stable")
    sampler = minhash.Sampler(minhash.BANDS * minhash.ROWS)
    samples = np.array([sampler(*sets[i]).astype(np.uint16) for i in order])
    nodes = [b"%d" % i for i in order]
    links = minhash._forest(nodes, nodes, samples, total[order], [sets[i] for i in order], 0.8)
    joined = {n: n for n in nodes}
    for a, b, similarity in links:
        assert similarity >= 0.8 and joined[a] != joined[b]  # no cycle
        assert similarity == pytest.approx(minhash.weighted_jaccard(sets[int(a)], sets[int(b)]))
        old = joined[b]
        joined = {n: joined[a] if x == old else x for n, x in joined.items()}


def test_every_pair_of_a_crowded_bucket_meets(spark):
    """Nodes that share no second band, in classes of one, two and many."""
    rng = random.Random(3)
    roots = [b"a"] * 9 + [b"b"] * 2 + [b"%d" % i for i in range(5)]
    rows = [
        (1, 0, len(roots), 1000.0, b"n%d" % i, root, [7] + [rng.randrange(10**9) for _ in range(11)], [0] * 36, 100.0 + i)
        for i, root in enumerate(roots)
    ]
    at = spark.createDataFrame(
        rows, "bucket long, band int, size long, weight double, node binary, root binary, bands array<long>, samples array<short>, total double"
    )
    cells = collections.defaultdict(set)
    for r in minhash._cells(at, -float(np.log(0.8)), 3).collect():
        cells[r["cell"]].add((bytes(r["node"]), bytes(r["root"])))
    met = {frozenset((a, b)) for c in cells.values() for (a, x), (b, y) in itertools.combinations(c, 2) if x != y}
    assert met == {frozenset((b"n%d" % i, b"n%d" % j)) for i, j in itertools.combinations(range(len(roots)), 2) if roots[i] != roots[j]}
    assert max(map(len, cells.values())) < len(roots)


def test_frequent_spans_are_joined_by_shares(spark, monkeypatch):
    """Copies of a passage with own words behind: the places of its spans travel in lists."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"x{i}y{j}" for j in range(5))])) for i in range(300)] + [(300, " ".join(passage[1:50]))]
    kept = {}
    put = Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, frame, name: kept.setdefault(name, put(self, frame, name)))
    got = {r["doc_id"]: r["n_removed"] for r in repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), hot=100).collect()}
    assert got == {i: 60 for i in range(300)} | {300: 49}
    shares = kept["shares"]
    places = shares.selectExpr("sum(n)").first()[0]
    assert places > 600 and shares.count() < places / 3


def test_plain_words_have_the_tokens_of_all_words():
    from xxhash import xxh3_64_intdigest

    from fleetspark.llm import quality

    words = ["word", "Word", "WORD", "WORD,", "word.", "Éa", "É", "ABÉ", "a_", "_", "x1", "1", "?", "??", "a??", "don't", "İx", "²", "a²", "a ", "á"]
    known = quality.Tokens()
    for word in words:
        core, shape = quality.core_and_shape(word)
        want = xxh3_64_intdigest(core) % quality.CORES * quality.SHAPES + xxh3_64_intdigest(shape) % quality.SHAPES
        assert known[word.encode()] == want


def test_words_parted_by_spaces_have_the_ids_of_single_ones():
    from fleetspark.llm.packing import WordIds

    coder = WordIds(tokenizer_file("word_bpe_49k.json"))
    words = ["plain", "été", "straße", "İstanbul", "don't", "x1y", "a</w>b", "<|endoftext|>", "ét", "日本語", "ﬁne", "zzzzqqq", "a,b", "end."]
    for some in (words, words[:3], words[3:]):
        coder.known.clear()
        coder.learn({w.encode().lower() for w in some})
        for w in some:
            ids = coder.tokenizer.encode(w.encode().lower().decode(), add_special_tokens=False).ids
            assert coder.known[w.encode().lower()] == np.array(ids, np.uint32).tobytes(), w


def test_a_worker_keeps_one_object(monkeypatch):
    import sys

    from fleetspark.llm.base import per_worker

    monkeypatch.delitem(sys.modules, "_held_by_this_worker", raising=False)
    first = per_worker(("a", 1), list)
    assert per_worker(("a", 1), list) is first
    per_worker(("b",), dict)
    held = sys.modules["_held_by_this_worker"].__dict__.values()
    assert not any(x is first for x in held)


def test_places_of_frequent_spans_are_not_handed_out_again(spark, monkeypatch):
    """Spans found once, in part or not at all elsewhere, are told; the places of all others are not listed or exploded."""
    rng = random.Random(5)
    length, passage = 12, [f"p{i}" for i in range(80)]
    rows = []
    for i in range(240):
        words = list(passage)
        for _ in range(i % 4):
            words[rng.randrange(80)] = f"own{i}"
        rows.append((i, " ".join([*words, *(f"x{i}y{j}" for j in range(i % 7))])))
    kept = {}
    put = Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, frame, name: kept.setdefault(name, put(self, frame, name)))
    got = {r["doc_id"]: r for r in repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), length=length, hot=20).collect()}
    split = {i: t.encode().split() for i, t in rows}
    seen = collections.Counter(tuple(w[p : p + length]) for w in split.values() for p in range(len(w) - length + 1))
    for i, w in split.items():
        gone = {q for p in range(len(w) - length + 1) if seen[tuple(w[p : p + length])] > 1 for q in range(p, p + length)}
        left = b" ".join(x for q, x in enumerate(w) if q not in gone)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone), hashlib.sha256(left).hexdigest())
    shares = kept["shares"]
    assert "array" not in str(shares.dtypes)
    assert shares.filter("n > 1").count() and shares.filter("n = 1").count()


def test_words_keep_their_ids_when_the_cache_is_emptied(monkeypatch):
    """Words of a to z go to the model at once; ids stay those of whole texts, however often words are forgotten."""
    from fleetspark.llm import packing

    coder = packing.WordIds(tokenizer_file("word_bpe_49k.json"))
    assert coder.plain.normalizer is None
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzéßÉİ"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 12))) + rng.choice(["", "", ".", "?!", "'s", "é,", "1"]) for _ in range(300)) for _ in range(6)]
    texts += ["", " \n", "ABC abc Abc.", ".,! a. é. 'll", "don't <|endoftext|>. a<|b"]
    for most in (packing.CACHE_BYTES, 0):
        monkeypatch.setattr(packing, "CACHE_BYTES", most)
        for _ in range(2):
            for text, raw in zip(texts, coder.texts(texts), strict=True):
                assert np.frombuffer(raw, "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
