"""Chat sequences, filter audits and whitening against brute force, and their defined results on odd rows."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from conftest import cases

from tracetide.llm import chat, filter_audit, whitening
from tracetide.llm.plans import QUERIES
from tracetide.llm.tokens import tokenizer_path
from tracetide.session import work_path

TURNS = "turn long, text string, conv_id long, role string, ids string, place long, tie int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest_by_hand(turns):
    """{conv: (n_turns, digest of turns, characters and digest of assistant texts)} of (conv, turn, role, text)."""
    convs = {}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv, _, role, text in sorted(turns, key=order):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, said in convs.items():
        loss = "".join(t for r, t in said if r == "assistant")
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


def test_chats_query(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    found = QUERIES["op11_chat_formatting"][0](spark, sf_dir).collect()
    want = digest_by_hand([*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    assert {r.conv_id: tuple(r)[1:5] for r in found} == want and len(found) == len(want)
    assert next(r.formatted_chars for r in found if r.conv_id == -1) == 2 * (len(said) + 3) + len("[INST][/INST]<s></s>")


def odd_turns():
    long_text = "word <s> " * 30_000
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, None, None, None), (1, 2, "assistant", "b"), (1, 2, "assistant", ""),
        (None, 1, "user", "x"), (None, None, "assistant", "<s>\\</s><\\s>"), (2, 1, "tool [END]", "[ROLE]x[/ROLE][END]"),
        (2, 2, "assistant", "<|endoftext|> [\\\\INST] <<SYS>>\x00 é漢 \U0001f600"), (3, 0, "system", "<<SYS>> <</SYS>>"), (3, 1, "", ""),
        (4, 0, "assistant", long_text), (4, 1, "user", long_text), (4, 2, "assistant", "end"),
    ]
    return [*rows, *((5, k, ("user", "assistant")[k % 2], f"turn {k} <s>") for k in range(300))]


def test_chats_of_odd_rows(spark):
    turns = odd_turns()
    df = spark.createDataFrame([(t, x, c, r, "i", 7, 1) for c, t, r, x in turns], TURNS).repartition(3)
    path = work_path(spark, "chats")
    chat.write_chats(df, path, piece_ids=64)
    pieces = chat.read_chats(spark, path)
    assert pieces.where("conv_id = 5").count() > 10  # a long conversation lies in many pieces
    found = {r.conv_id: tuple(r)[1:] for r in chat.digests(pieces).collect()}
    want = digest_by_hand(turns)
    assert {c: f[:4] for c, f in found.items()} == want
    rows = sorted(chat.formatted(pieces).collect(), key=lambda r: (str(r.conv_id), r.place))
    texts = {}
    for r in rows:
        assert chat.parsed(r.text) == [(t.role, t.text) for t in r.turns]
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.text
    assert {c: len(t) for c, t in texts.items()} == {c: f[4] for c, f in found.items()}
    assert texts[4].count("<s>") == 2  # markers alone
    empty = work_path(spark, "chats")
    chat.write_chats(df.limit(0), empty)
    assert chat.digests(chat.read_chats(spark, empty)).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(4)
    parts = [*chat.CONTROLS, *(c[1:] for c in chat.CONTROLS), "\\", "\\\\", "<", "[", " x", "é", "/"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        safe = chat.escaped(text)
        assert chat.unescaped(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_masks_are_those_of_a_walk():
    code = chat.codec(tokenizer_path(chat.TOKENIZER))
    roles = ["user", "assistant", "assistant", "system", "tool", "assistant"]
    texts = ["a b", "c <s> d", "", "e", "f", "g h i"]
    ids, want = [], []
    for role, text in zip(roles, texts, strict=True):
        inner, named = code.encode([chat.escaped(text), role])
        turn = code.turn(role, named, inner)
        ids += turn
        want += [role == "assistant" and i < code.base for i in turn]
    assert code.mask(np.array(ids)).tolist() == want


def audit_by_hand(docs, labels):
    """Rows of the audit from every order, one filter at a time; docs of (doc_id, part, text)."""
    blank = " \t\n\x0b\x0c\r"
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    failed = []
    for i, part, t in docs:
        words = "".join(" " if c in blank else c for c in t).split(" ")
        words = [w for w in words if w]
        fails = {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and least[t] < i), strict=True) if bad}
        failed.append((i, part, fails))
    out = {}
    for part in {p for _, p, _ in failed}:
        own = [(i, fails) for i, p, fails in failed if p == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                bad = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(bad)
                out[part, "".join(order), step] = [
                    len(left), len(bad), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in own),
                    sum(labels.get(x[0], (0, 0))[0] for x in bad), sum(labels.get(x[0], (0, 0))[1] for x in bad),
                ]
                gone = gone + bad
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found_audit(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


@pytest.mark.parametrize("counters", [filter_audit.MAX_COUNTERS, 32768, 64])
def test_audit_by_hand(spark, odd, counters):
    """Also with repeated and null ids, and with sketches so full that every text is a possible repeat."""
    docs = [(r.doc_id, r.source or "", r.text or "") for r in odd.collect()]
    more = [(100 + k % 70, f"s{k % 3}", " ".join(f"w{(k % 60) * j}" for j in range(k % 60 * 7))) for k in range(200)]
    more += [(500 + k, "hot", "the same") for k in range(300)] + [(5, "hot", "the same"), (5, "a", "the same")]
    table = odd.unionByName(spark.createDataFrame([(i, t, p) for i, p, t in more], "doc_id long, text string, source string"), allowMissingColumns=True)
    labels = [(5, 1, 0), (5, 0, 1), (7, 1, None), (8, None, 1), (None, 1, 1), (510, 1, 1), (120, 1, 0)]
    by_id = {5: (1, 1), 7: (1, 0), 8: (0, 1), 510: (1, 1), 120: (1, 0)}
    found = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_counters=counters)
    assert found_audit(found) == audit_by_hand([*docs, *more], by_id)


def test_audit_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = none.unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"), allowMissingColumns=True)
    found = found_audit(filter_audit.audit(one, labels))
    assert len(found) == 600 and found["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_sketch_clears_unique_texts(spark):
    """No repeat is cleared, and nearly every unique text is."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 10 = 0, 'r' || id % 500, 't' || id) AS text")
    hashed = rows.select("doc_id", "text", *filter_audit._hashes(rows.text))
    counters = filter_audit.counters_for(20_000)
    left = filter_audit.possible_repeats(hashed, filter_audit.sketch(hashed, counters), counters)
    assert left.where("doc_id % 10 = 0").count() == 2000
    assert left.where("doc_id % 10 <> 0").count() < 0.02 * 18_000
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def whitened_by_hand(vectors):
    """Distinct grid vectors, sums, and eigenvalues of their covariance by the library."""
    x = np.unique(np.array(vectors, dtype=np.int64), axis=0)
    centred = x - x.mean(axis=0)
    values, components = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], components[:, ::-1]


def test_whitening_query(spark, sf_dir):
    rows = {r.vec_id: np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(np.int64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    x, values, components = whitened_by_hand(list(rows.values()))
    n, sums = len(x), x.sum(axis=0)
    found = QUERIES["op13_embedding_whitening"][0](spark, sf_dir).collect()
    assert len(found) == 4 * len(rows)
    signs = {}
    for r in found:
        v = rows[r.vec_id]
        assert r.n == n and r.deviation == int(((n * v - sums) ** 2).sum()) == int(r.deviation_exact)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-10
        want = (v - sums / n) @ components[:, r.component - 1] / np.sqrt(values[r.component - 1])
        sign = signs.setdefault(r.component, 1.0 if want * r.whitened > 0 else -1.0)
        assert r.whitened == pytest.approx(sign * want, abs=1e-8)


@pytest.mark.parametrize("kind", ["full", "flat", "scaled", "equal"])
def test_factor_and_rotations(kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 17))
    if kind == "flat":
        x = x[:, :5] @ rng.normal(size=(5, 17))
    if kind == "scaled":
        x *= 10.0 ** np.linspace(-3, 3, 17)
    if kind == "equal":
        x = np.vstack([np.eye(17), -np.eye(17)])
    scatter = x.T @ x
    factor = whitening.pivoted_cholesky(scatter)
    assert factor.shape[1] == (5 if kind == "flat" else 17)
    assert np.abs(factor @ factor.T - scatter).max() <= 1e-12 * np.abs(scatter).max()
    values, vectors = whitening.one_sided_jacobi(factor)
    want = np.linalg.eigvalsh(scatter)[::-1][: len(values)]
    assert np.allclose(values, want, rtol=1e-9, atol=1e-14 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    data = [
        (1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 0.25]), (None, [3.0, 1.0, -0.5]), (4, None), (5, [1.0, None, 1.0]),
        (6, [inf, 0.0, 0.0]), (7, [nan, 0.0, 0.0]), (8, []), (9, [0.001]), (10, [2.0, 2.0, 2.0]), (11, [-0.001, -1.0, 7.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in data], "vec_id long, embedding array<double>, x string, n int")
    rows = whitening.grid_rows(df)
    assert sorted((r.vec_id or 0, r.x) for r in rows.collect()) == sorted(
        (i or 0, [int(np.floor(256 * c)) for c in v]) for i, v in data if v is not None and all(c is not None and np.isfinite(c) for c in v)
    )
    model = whitening.fitted(rows)
    full = [[*map(lambda c: int(np.floor(256 * c)), v), *[0] * (3 - len(v))] for i, v in data if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x, values, _ = whitened_by_hand(full)
    assert model.n == len(x) == 6 and model.sums == x.sum(axis=0).tolist() and model.identity_error < 1e-10
    assert np.allclose(model.values, values)
    out = whitening.whitened(rows, model).collect()
    assert len(out) == len(full) and all(len(r.whitened) == 3 for r in out)
    for r in out:
        assert r.deviation == int(r.deviation_exact)
    huge = spark.createDataFrame([(k, [1e300 * k, 3.0 * k]) for k in range(3)], "vec_id long, embedding array<double>")
    kept = whitening.grid_rows(huge)
    big = whitening.whitened(kept, whitening.fitted(kept)).collect()
    assert [r.deviation for r in big].count(None) >= 2 and len(big) == 3
    for part in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 8")):
        alone = whitening.grid_rows(part)
        model = whitening.fitted(alone)
        assert len(model.values) == 0 and [r.whitened for r in whitening.whitened(alone, model).collect()] == [[]] * part.count()


def test_exact_deviations_beyond_a_long():
    x = np.array([[5, -7], [100, 3]])
    n, sums = 10**10, [3 * 10**11, -(10**10)]
    assert whitening._deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def test_cases_hold_nulls():
    assert any(r[0] is None for r in cases())
