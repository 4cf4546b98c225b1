import hashlib
import random
import re

from odd import ODD
from pyspark.sql import functions as F

from tesserae.llm import secrets as S

HEXES = "0123456789abcdef"
CASES = {
    "password = hunter22": ["assign:0:19"],
    "PassWord:short": [],
    "api_key: 'abcdefgh' Token=\"ABC.def/12=\"": ["assign:0:18", "assign:20:38"],
    "AKIA1234567890AB AKIA123": ["access:0:16"],
    "é" + "ab12" * 8: ["hex:1:33"],
    "secret=" + "ab12" * 8: ["assign:0:39", "hex:7:39"],
    "ſecret=abcdefghij toKen=abcdefgh": ["assign:18:32"],
}


def text(rng, value, key="", words=30):
    w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(words)]
    w[rng.randrange(words)] = f"{key}{value}"
    return " ".join(w)


def corpus(n=400, seed=3):
    """Texts with assigned values, card numbers and dates; and texts with bare values, which only the network can find."""
    rng = random.Random(seed)
    value = lambda: "".join(rng.choice(HEXES) for _ in range(20))
    known = [text(rng, value(), "password=") for _ in range(n)]
    harmless = [text(rng, "".join(rng.choice("0123456789") for _ in range(16))) for _ in range(n)] + [text(rng, f"{rng.randrange(1900, 2100)}-{rng.randrange(10, 12)}-{rng.randrange(10, 28)}-report") for _ in range(n)]
    bare = [text(rng, value()) for _ in range(60)]
    return known, harmless, bare


def test_patterns(spark, docs):
    rows = {r.doc_id: r for r in S.digest(S.spans_of(docs(list(CASES)).select("doc_id", "text"))).collect()}
    for i, want in enumerate(CASES.values()):
        assert rows[i].spans == ",".join(want) and rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in S.KINDS[:3])


def test_network_finds_bare_values_and_leaves_numbers_alone(spark, docs):
    known, harmless, bare = corpus()
    texts = known + harmless + bare
    rows = {r.doc_id: r for r in S.digest(S.spans_of(docs(texts).select("doc_id", "text").repartition(6))).collect()}
    first, last = len(known) + len(harmless), len(texts)
    assert sum(rows[i].n_model for i in range(first, last)) >= 0.85 * len(bare)
    assert sum(rows[i].n_model > 0 for i in range(len(known), first)) <= 0.02 * len(harmless)
    for i in range(first, last):
        for span in rows[i].spans.split(",") if rows[i].spans else []:
            kind, a, b = span.split(":")
            assert kind == "model" and re.fullmatch("[0-9a-f]{20}", texts[i][int(a) : int(b)])


def test_odd_rows_and_columns(spark, docs):
    found = S.spans_of(docs([*ODD, "x token=abcdefgh1 é secret=" + "ab12" * 9], clash=True))
    assert found.columns.count("found") == 1 and "lang" in found.columns
    rows = {r.doc_id: r.spans for r in S.digest(found).collect()}
    assert rows.pop(len(ODD)) == "assign:2:17,assign:20:63,hex:27:63" and set(rows.values()) == {""}
    assert S.spans_of(docs([])).count() == 0


def test_redaction(spark, docs):
    texts = [None, "", "nothing", "é token=abcdefgh1, then password: " + "ab12" * 8 + "!", "token=abcdefgh1"]
    rows = {r.doc_id: r for r in S.redact(docs(texts)).collect()}
    assert [rows[i].text for i in range(5)] == [None, "", "nothing", "é <ASSIGN>, then <ASSIGN>!", "<ASSIGN>"]
    assert all(rows[i].n_chars == (None if t is None else len(rows[i].text)) for i, t in enumerate(texts))
    assert S.redact(docs(texts)).columns == docs(texts).columns


def test_windows_stay_within_their_document():
    import pyarrow as pa

    raw, offsets = S.utf8(pa.array(["left 1234567890abc right", "9" * 100, "z"]))  # shorter runs are no candidates
    s, e, d = S.candidates(raw, offsets)
    x = S.windows(raw, offsets, s, e, d)
    assert d.tolist() == [0, 1] and bytes(x[0][S.LEFT : S.LEFT + 13]) == b"1234567890abc" and bytes(x[0][S.LEFT - 5 : S.LEFT]) == b"left "
    assert bytes(x[0][-S.RIGHT :]).rstrip(b"\0") == b" right" and x[1][: S.LEFT].sum() == 0 and x[1][-S.RIGHT :].sum() == 0


def test_a_key_behind_a_long_path_is_found(spark, docs):
    known, harmless, _ = corpus()
    rng = random.Random(9)
    path = "/services/" + "/".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(9)) + "/"
    keys = [path + "".join(rng.choice(HEXES) for _ in range(20)) for _ in range(20)]
    texts = known + harmless + [text(rng, k) for k in keys]
    found = S.digest(S.spans_of(docs(texts).select("doc_id", "text").repartition(6))).where(F.col("doc_id") >= len(known) + len(harmless)).collect()
    assert len(path) > S.BODY and sum(r.n_model for r in found) >= 0.7 * len(keys)


def test_copies_dont_fill_the_sample(spark, docs, monkeypatch):
    rng = random.Random(11)
    seen = {}
    monkeypatch.setattr(S, "train", lambda x, y: seen.update(x=x, y=y))
    texts = [text(rng, "0123456789abcdef", "password=")] * 200 + [text(rng, f"{rng.randrange(10**15)}x", "password=") for _ in range(30)]
    S.train_on(docs(texts).repartition(4), trained=30)
    own = seen["x"][seen["y"] == 1]  # words of eight letters are candidates, too
    assert len(own) == 30 == len({r.tobytes() for r in own}) and len(seen["x"]) <= 60


def test_scan_is_the_patterns_on_every_text():
    """By the task's patterns, written out here, and without the search for documents that may match."""
    import pyarrow as pa

    rng = random.Random(13)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "APIkey", "=", ":", " ", "  ", "\"", "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 4, "\n", "é", "x", "hunter22!", "/+_.=-", "中"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3000)]
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")
    raw, offsets = S.utf8(pa.array(texts))
    found = S.scan(raw, offsets)[0]
    for text_, got in zip(texts, found, strict=True):
        want = [(m.start(), m.end(), 0) for m in assign.finditer(text_) if len(m[2]) >= 8]
        want += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text_) if len(m[0]) >= 16]
        want += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text_) if len(m[0]) >= 32]
        assert got == sorted(want, key=lambda x: (x[0], x[2])), text_


def test_overlaps_are_brute_force():
    import numpy as np

    rng = random.Random(14)
    for _ in range(300):
        spans = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(6)))]
        asked = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(8))]
        cols = lambda x: np.array(x, np.int64).reshape(-1, 2).T
        assert S.overlaps(*cols(spans), *cols(asked)).tolist() == [any(a < d and c < b for a, b in spans) for c, d in asked]


def test_many_findings_in_one_text_take_linear_time():
    import time

    import pyarrow as pa

    def took(n):
        raw, offsets = S.utf8(pa.array([" ".join(f"token=abcdefgh{i} word{i}abcdef" for i in range(n))]))
        began = time.perf_counter()
        assert len(S.scan(raw, offsets)[0][0]) == n
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 12 * max(took(10_000), 0.05)


def test_every_run_reaches_the_network(spark, docs, monkeypatch):
    """Runs without a digit and the ends of long ones are asked, and a network that says yes to all marks all of them."""
    seen = {}
    monkeypatch.setattr(S, "train", lambda x, y: seen.update(x=x, y=y))
    S.train_on(docs(["lettersonly password=secretvalue9 short12 " + "q" * 60 + "z"]))
    bodies = {bytes(r[S.LEFT : S.LEFT + S.BODY]).rstrip(b"\0"): int(k) for r, k in zip(seen["x"], seen["y"], strict=True)}
    assert bodies == {b"lettersonly": 0, b"secretvalue9": 1, b"q" * S.BODY: 0}  # "password" stands beside a value, "short12" is too short


def test_tables_are_the_network():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (300, S.WINDOW)).astype(np.uint8)
    x[rng.random(x.shape) < 0.2] = 0
    net = S.train(x, np.arange(300) % 2)
    whole = S._forward(net, x)[0]
    assert np.abs(S.logits(net, x) - whole).max() < 1e-3 * max(1, np.abs(whole).max())
    assert 0 <= net["threshold"] <= 1


def labelled_windows(texts):
    """Distinct windows of findings, and windows of candidates beside none, of all texts one by one."""
    import numpy as np
    import pyarrow as pa

    yes, no = [], []
    for t in texts:
        raw, offsets = S.utf8(pa.array([t]))
        _, s, e, d, meets, holds, _, _ = S.scan(raw, offsets)
        x = S.windows(raw, offsets, s, e, d)
        yes.append(x[holds])
        no.append(x[~holds & ~meets])
    return np.unique(np.concatenate(yes), axis=0), np.concatenate(no)


def test_all_windows_train_and_all_held_out_findings_set_the_threshold(spark, docs):
    known, harmless, _ = corpus()
    texts = known + harmless
    net = S.train_on(docs(texts).repartition(6), trained=30)
    yes, no = labelled_windows(texts)
    asked = yes[S.held_out(S.hashes(yes))]
    assert len(yes) > 300 and net["read"] == (len(yes) - len(asked)) + int((~S.held_out(S.hashes(no))).sum())
    assert net["asked"] == 2 * len(asked) > 6 * 30  # with its own and with a swapped context
    assert (S.probabilities(net, asked) >= net["threshold"]).mean() >= 0.97


def test_what_the_start_never_saw_is_learnt(spark, docs):
    """Harmless runs without a digit that look like hexadecimal values; hashes keep nearly all out of the start."""
    known, harmless, _ = corpus()
    rng = random.Random(21)
    alike = lambda: "".join(rng.choice("abcdef") for _ in range(20))
    texts = known + harmless + [text(rng, alike()) for _ in range(400)]
    frame = docs(texts).repartition(6)
    start, seen = S.start_on(frame, 20)
    nets = [S.calibrated(frame, n) for n in (start, S.descended(frame, start, seen))]
    _, new = labelled_windows([text(rng, alike()) for _ in range(200)])
    new = new[(new[:, S.LEFT + 19] != 0)]
    wrong = [(S.probabilities(n, new) >= n["threshold"]).mean() for n in nets]
    assert len(new) == 200 and wrong[0] > 0.5 and wrong[1] < 0.6 * wrong[0], wrong


def test_windows_at_the_ends_are_brute_force():
    import pyarrow as pa

    rng = random.Random(22)
    texts = [bytes(rng.choice(b"abc1/ .") for _ in range(rng.choice([0, 1, 8, 9, 40, 200]))).decode().replace(" ", " " * rng.randrange(2)) for _ in range(300)]
    raw, offsets = S.utf8(pa.array(texts))
    s, e, d = S.candidates(raw, offsets)
    for row, a, b, t in zip(S.windows(raw, offsets, s, e, d), s - offsets[d], e - offsets[d], (texts[i].encode() for i in d), strict=True):
        assert bytes(row) == t[max(a - S.LEFT, 0) : a].rjust(S.LEFT, b"\0") + t[a : min(b, a + S.BODY)].ljust(S.BODY, b"\0") + t[b : b + S.RIGHT].ljust(S.RIGHT, b"\0")
