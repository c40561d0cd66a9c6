"""Secret scan, periodic runs and conversation repair against brute-force versions, with the odd rows that tables hold."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from mdloom.llm import conversation_repair as C
from mdloom.llm import periodic_runs as P
from mdloom.llm import queries as Q
from mdloom.llm import secret_scan as S

EXTRA = "kind int, start long, base string, part int, report int, copy_ int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def extended(spark, rows, ddl):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in rows], f"{ddl}, {EXTRA}").repartition(4)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# periodic runs


def runs_by_definition(words, least=6, times=4):
    """Every maximal stretch of every period, less those that have a smaller one."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        for same, group in itertools.groupby(range(n - q), lambda i: words[i] == words[i + q]):
            at = list(group)
            size = len(at) + q
            if same and size >= max(least, times * q) and not any(all(words[i] == words[i + d] for i in range(at[0], at[0] + size - d)) for d in range(1, q)):
                out.append((at[0], size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def few_words(rng):
    words = [rng.choice("abcd"[: rng.randint(1, 4)]).encode() for _ in range(rng.randint(0, 60))]
    if words and rng.random() < 0.7:
        a, p = rng.randrange(len(words)), rng.randint(1, 7)
        words = [w if i < a else words[a + (i - a) % p] if a + (i - a) % p < len(words) else w for i, w in enumerate(words)]
    return words


def test_runs_of_small_alphabets():
    rng = random.Random(3)
    many = [few_words(rng) for _ in range(1500)] + [[], [b"a"], [b"a"] * 6, [b"a"] * 5, [b"a", b"b"] * 4, [b"a", b"b"] * 3]
    for words, runs in zip(many, P.find_runs(many), strict=True):
        assert [tuple(r) for r in runs.tolist()] == runs_by_definition(words)


def test_runs_with_other_bounds():
    rng = random.Random(4)
    many = [few_words(rng) for _ in range(300)]
    for words, runs in zip(many, P.find_runs(many, 4, 2), strict=True):
        assert [tuple(r) for r in runs.tolist()] == runs_by_definition(words, 4, 2)


def test_common_extensions():
    rng = random.Random(5)
    text = [rng.randint(1, 3) for _ in range(300)] + [1, 2] * 40
    ahead = P.Extensions(*P.SuffixTree(text).tour(True))
    a, b = np.array([(i, j) for i, j in (rng.sample(range(len(text)), 2) for _ in range(2000))]).T
    want = [sum(1 for _ in itertools.takewhile(lambda t: t[0] == t[1], zip(text[i:], text[j:], strict=False))) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert ahead.of(a, b).tolist() == want


def test_periodic_runs_over_odd_rows(spark):
    texts = [None, "", " \n\t", "a", "a " * 6, "a b " * 50 + "c", "x " + "é日 ü " * 9, "p q r s t u v w " * 5000, "\x00 \x00 " * 8, " ".join(str(i) for i in range(3000)), "y" * 2_000_000, "ab " * 1_000_000]
    rows = [*enumerate(texts), (4, "a " * 6), (None, "b " * 7), (None, "b " * 7), (2**60, "z z z z z z")]
    got = P.periodic_runs(extended(spark, rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        found = runs_by_definition(words) if len(words) < 5000 else [(0, len(words), 8 if "p q" in t else 1)]
        gone = {x for s, n, q in found for x in range(s + q, s + n)}
        want.append((i, len(words), found, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.periodic_runs(empty).collect() == []


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 13))) for i in range(300)] + [(None, "a b"), (7, None)]
    got = {(r.doc_id, r.text) for r in Q.planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        h = zlib.crc32(str(i).encode())
        w = (t or "").split()
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            t = " ".join(x if k < a else w[a + (k - a) % p] for k, x in enumerate(w))
        want.add((i, t))
    assert got == want


# conversation repair


def cheapest_by_search(symbols):
    """Dijkstra's algorithm over (cost, edits), by place and state."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, edits, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(symbols) and q in (0, 3):
            return cost, edits
        after = {0: 2, 1: 2, 2: 3, 3: 2}[q]
        heapq.heappush(heap, (cost + 2, edits + "I", i, after))
        if i < len(symbols):
            must_go, initial, cut = symbols[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, q))
            if not must_go:
                heapq.heappush(heap, (cost + 2 + cut, edits + "R", i + 1, after))
                stays = q if initial == "" else {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, initial))
                if stays is not None:
                    heapq.heappush(heap, (cost + cut, edits + "K", i + 1, stays))


@pytest.mark.parametrize("longest", [3, 17])
def test_block_tables_find_the_cheapest_edits(longest):
    rng = random.Random(longest)
    for _ in range(3000):
        rows = [(rng.random() < 0.2, rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.randint(0, 1)) for _ in range(rng.randint(0, longest))]
        code = np.array([0 if gone else 1 + 2 * ["s", "u", "a", "x", ""].index(initial) + cut for gone, initial, cut in rows], np.uint8)
        assert C.cheapest(code) == cheapest_by_search(rows)


def repaired_by_definition(rows):
    """The report of one conversation's rows, in order."""
    seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        left = text.rstrip(C.SPACE)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else None if left[-1] in ".!?" else "truncated"
        if fault:
            faults[fault] += 1
        seen.add((role, text))
        symbols.append((fault in ("blank", "duplicate"), role[:1] if role[:1] in ("s", "u", "a", "") else "x", int(fault == "truncated")))
    cost, edits = cheapest_by_search(symbols)
    out, rest, last = [], list(rows), ""
    for e in edits:
        if e == "I":
            out.append(("assistant" if last == "u" else "user", ""))
        else:
            _, role, text = rest.pop(0)
            if e == "D":
                continue
            out.append((("assistant" if last == "u" else "user") if e == "R" else role, text))
        last = out[-1][0][:1] or last
    assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in out))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *faults.values(), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, edits, sha("\n".join(f"{r}:{t}" for r, t in out))


def test_conversations_over_odd_rows(spark):
    rng = random.Random(8)
    said = ["Yes.", "No!", "and then", "", " \n", "日本。", "ok?  ", "Yes.", "x" * 300_000]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice([None, "system", "user", "assistant", "user", "assistant", "tool", "", "Über"]), rng.choice([None, *said])) for c in [*range(40), None, 2**60] for _ in range(rng.randint(1, 12))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)] + [(78, 1, "user", "same.")] * 500
    table = extended(spark, rows, "conv_id long, turn long, role string, text string")
    reports = C.audits(table)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_reports(table, reports).collect()}
    told = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        told.setdefault(c, []).append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())
    assert got == {c: repaired_by_definition(sorted(r, key=order)) for c, r in told.items()}
    messages = C.repaired_messages(table, reports).where("conv_id = 77").orderBy("place").collect()
    assert [(m.place, m.edit, m.role, m.text) for m in messages] == [(t, "K", ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair_reports(empty, C.audits(empty)).collect() == []


def test_every_damage(spark):
    rows = [(c, t if (c + t) % 11 else None, ("user", "assistant")[t % 2] if t % 5 else None, f"Say {t}! Now?") for c in range(60) for t in range(6)] + [(None, 1, "user", None)]
    got = sorted(((r.conv_id, r.turn, r.role, r.text, r.copy) for r in Q.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("there").collect()), key=str)
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if fault:
            one = (c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            want += [(*one, k) for k in range(2 if fault == 3 else 1)]
    assert got == sorted(want, key=str)
    assert {c for c, *_ in rows} == {r.conv_id for r in Q.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}


# secrets


def base_by_definition(text):
    out = []
    kinds = (("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))
    for n, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def made_up(rng, n):
    """Texts with secrets of every kind, and their likes that aren't."""
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    prose = lambda: " ".join(rng.choice(["the", "and", "report", "of", "order", "été", "2024-01-05", "page", "555-0199", "10.20.30.40", "version-1.2.3", str(rng.randrange(10**12))]) for _ in range(rng.randint(3, 12)))
    made = [lambda: f'token = "{hexes(40)}"', lambda: f"PASSWORD: {hexes(10)}", lambda: f"AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOP0123456789') for _ in range(16))}", lambda: hexes(32), lambda: "secret: no", lambda: "AKIAX", lambda: hexes(20)[:15], prose, prose, prose]
    return [" ".join(x for _ in range(4) for x in (prose(), rng.choice(made)())) for _ in range(n)]


def test_base_findings_by_definition():
    rng = random.Random(2)
    parts = ["token", "Secret", "api_key", "APIKEY", "ſecret", "toKen", "password", "passwd", "=", ":", " ", "'", '"', "abcd", "12345678", "AKIA", "ABC123", "0123456789abcdef" * 2, "deadbeef", "é", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(S.KINDS[k], a, b) for a, k, b in S.base_findings(text)] == base_by_definition(text)


def test_gradient():
    r = np.random.default_rng(0)
    net = S.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(1, 128, (5, 2 * S.AROUND + S.CHUNK)).astype(np.uint8), (r.random((5, 3)) > 0.5).astype(float)
    loss = lambda: np.mean((np.logaddexp(0, o := net.forward(x)[-1]) - y * o).sum(axis=1))
    for k, g in net.gradient(x, y, np.ones_like(y)).items():
        flat = net.p[k].reshape(-1)
        for i in r.integers(S.DIM, flat.size, 5) if k == "embed" else r.integers(0, flat.size, 5):
            old = flat[i]
            high, low = (flat.__setitem__(i, old + s) or loss() for s in (1e-5, -1e-5))
            flat[i] = old
            assert abs((high - low) / 2e-5 - g.reshape(-1)[i]) < 1e-4


def test_windows_hold_every_candidate_whole():
    text = "before " + "a1" * 400 + " after key=" + "Zz9" * 5
    chars = S.characters(text)
    found = S.candidates(chars, [])
    assert [text[a:b] for a, b in found.tolist()] == ["a1" * 400, "key=" + "Zz9" * 5]
    owner, x = S.windows(chars, found)
    for k, (a, b) in enumerate(found.tolist()):
        seen = b"".join(bytes(row[S.AROUND : S.AROUND + (S.STEP if i < (owner == k).sum() - 1 else S.CHUNK)]) for i, row in enumerate(x[owner == k])).rstrip(b"\0")
        assert seen.decode() == text[a:b]
    assert bytes(x[0][: S.AROUND]).lstrip(b"\0") == b"before " and bytes(x[-1][S.AROUND + S.CHUNK :]).rstrip(b"\0") == b""


@pytest.fixture(scope="module")
def scanner(spark):
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate(made_up(rng, 800))] + [(None, None), (1, "")]
    return S.learn_secrets(extended(spark, rows, "doc_id long, text string"))


def test_held_out_findings_are_known_again(scanner):
    """On texts it hasn't seen the network finds nearly all that the patterns find, and flags few other candidates."""
    found = missed = other = wrong = 0
    for text in made_up(random.Random(12), 400):
        base, chars = S.base_findings(text), S.characters(text)
        spans = S.candidates(chars, base)
        owner, x = S.windows(chars, spans)
        reach = scanner.kinds(x, owner, len(spans))
        for (a, b), kinds in zip(spans.tolist(), reach, strict=True):
            known = {k for s, k, e in base if s < b and e > a}
            if known:
                found += len(known)
                missed += sum(not kinds[k] for k in known)
            else:
                other += 1
                wrong += kinds.any()
    assert found > 300 and missed <= 0.1 * found and other > 1000 and wrong <= 0.05 * other


def test_scores_are_calibrated(scanner):
    rng = random.Random(13)
    chance, hit = [], []
    for text in made_up(rng, 300):
        base, chars = S.base_findings(text), S.characters(text)
        spans = S.candidates(chars, base)
        owner, x = S.windows(chars, spans)
        chance += scanner.probability(scanner.network.logits(x)[:, 2].astype(float), 2).tolist()
        hit += [any(k == 2 and s < spans[o][1] and e > spans[o][0] for s, k, e in base) for o in owner]
    assert abs(np.mean(chance) - np.mean(hit)) < 0.05


def test_learning_takes_every_chunk(spark):
    """Thresholds come from all held-back findings, and each chunk to learn from is in a bucket, one of a rare label in several."""
    rows = list(enumerate(made_up(random.Random(14), 4000)))
    docs = extended(spark, rows, "doc_id long, text string")
    scanner = S.learn_secrets(docs)
    chunks = S.labelled_chunks(docs).selectExpr("chunk", "label", "xxhash64(chunk) as hash").distinct().selectExpr("*", "pmod(shiftright(hash, 20), 4) = 0 as held")
    held = chunks.where("held").collect()
    x, y = S.windows_of([bytes(r.chunk) for r in held], [r.label for r in held])
    logits = scanner.network.logits(x).astype(float)
    for k in range(3):
        chance = scanner.probability(logits[:, k], k)[y[:, k] > 0]
        assert len(chance) > 200 and abs((chance >= scanner.threshold[k] - 1e-9).sum() - np.ceil(S.RECALL * len(chance))) <= 1
    learn = chunks.where("not held")
    sizes = dict(learn.groupBy("label").count().collect())
    buckets = S.dealt(learn, sizes).collect()
    assert sum(n for k, n in sizes.items() if k) > 2000 and {bytes(c) for r in buckets for c in r.chunk} == {bytes(r.chunk) for r in learn.collect()}
    assert len(buckets) > 1 and all(set(r.label) == set(sizes) for r in buckets)


def test_findings_over_odd_rows(spark, scanner):
    rows = [(1, None), (2, ""), (3, "secret: abcdefgh"), (3, "secret: abcdefgh"), (None, "AKIA" + "A1" * 8), (2**60, "é token='" + "f" * 40 + "' 😀 " + "0" * 32), (5, "a1" * 1_500_000), (6, "word " * 400_000)]
    got = S.find_secrets(extended(spark, rows, "doc_id long, text string"), scanner).collect()
    assert sorted(str((r.doc_id, [tuple(x) for x in r.base])) for r in got) == sorted(str((i, base_by_definition(t or ""))) for i, t in rows)
    for r in got:
        assert set(map(tuple, r.base)) <= set(map(tuple, r.findings))
        assert [(x.start, S.KINDS.index(x.kind)) for x in r.findings] == sorted((x.start, S.KINDS.index(x.kind)) for x in r.findings)
    empty = spark.createDataFrame([], "doc_id long, text string")
    nothing = S.learn_secrets(empty)
    assert S.find_secrets(empty, nothing).collect() == []
    assert S.find_secrets(spark.createDataFrame([(1, "x a1b2c3d4e5 y")], "doc_id long, text string"), nothing).first().findings == []


def test_secret_query_over_the_whole_table(spark):
    data = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in Q.op11_secret_scan(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = base_by_definition(d.text or "")
        r = got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in S.KINDS)
        told = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == sha(",".join(told)) and set(told) <= set(r.spans.split(","))  if told else r.base_sha256 == sha("")
