"""Conversation repair, exact copies and spelling variants against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from barweave.llm import conversation_cyk as cyk, exact_trie, queries, spelling_permuterm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, component_id string, n string, word string, owner string"
TURN = "conv_id long, turn long, role string, text string, copies string, seg string, content string"


# ---- conversations


def plain_damage(rows):
    """(conv_id, turn, role, text) in any order to each conversation's rows after damage, in order of turn."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else x
        dealt = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text, own = one(role), one(text), out[conv]
        if dealt == 0:
            continue
        text = "" if dealt == 1 else re.sub("[.!?]", "", text) if dealt == 2 else text
        own += [(turn, "user" if dealt == 4 else role, text)] * (2 if dealt == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: ((r[0] is not None), r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edits(rows, found, most):
    """Every sequence of edits of at most that cost that gives a good conversation: (cost, audit, turns)."""
    stack = [(0, "", 0, ())]
    while stack:
        cost, audit, at, turns = stack.pop()
        initials = "".join(r[:1] if r else "-" for r, _ in turns)
        if not re.fullmatch("s?(ua)*u?", initials):
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            yield cost, audit, turns
        options = [(3, "I", 0, (role, "")) for role in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            options.append((4, "D", 1, None))
            if found[at] not in ("blank", "duplicate"):
                more = 3 * (found[at] == "truncated")
                options += [(more, "K", 1, (role, text))] + [(3 + more, "R", 1, (x, text)) for x in ("user", "assistant")]
        stack += [(cost + c, audit + e, at + k, turns + ((t,) if t else ())) for c, e, k, t in options if cost + c <= most]


def by_rows(rows, found):
    """The same from the first row on, over what was said last: for longer conversations."""
    after = {"": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def with_new(states):
        for _ in range(3):
            for state, (cost, audit, turns) in list(states.items()):
                for role in ("user", "assistant"):
                    if (to := after[state].get(role[0])) and (to not in states or (cost + 3, audit + "I") < states[to][:2]):
                        states[to] = (cost + 3, audit + "I", (*turns, (role, "")))
        return states

    states = with_new({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, found, strict=True):
        new = {}
        for state, (cost, audit, turns) in states.items():
            options = [(state, 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options += [(after[state].get(role[:1] or "-"), more, "K", ((role, text),))] + [(after[state].get(x[0]), 3 + more, "R", ((x, text),)) for x in ("user", "assistant")]
            for to, c, e, t in options:
                if to is not None and (to not in new or (cost + c, audit + e) < new[to][:2]):
                    new[to] = (cost + c, audit + e, turns + t)
        states = with_new(new)
    return min(v for k, v in states.items() if k in ("", "a"))


def plain_report(rows, answer):
    found = faults(rows)
    cost, audit, turns = answer(rows, found)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def reported(spark, rows, parts=3, most=4096):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURN).repartition(parts)
    return {r[0]: tuple(r[1:]) for r in cyk.report(cyk.damaged(table), most).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def chat(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "cut", "", " \n", "ask?  ", None, "a.b", "Yes.", "."]
    return [(conv, t if rng.random() > 0.05 else None, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]) for t in rng.permutation(n * 2)[:n].tolist()]


def test_every_sequence_of_edits(spark):
    rng = np.random.default_rng(1)
    rows = [r for c in range(60) for r in chat(rng, c, int(rng.integers(1, 5)))]
    plain = plain_damage(rows)

    def answer(own, found):
        most = by_rows(own, found)[0]
        best = min(edits(own, found, most))
        assert best[0] == most
        return best

    assert reported(spark, rows) == {c: plain_report(plain[c], answer) for c in {r[0] for r in rows}}


def test_long_null_repeated_and_clashing(spark):
    rng = np.random.default_rng(2)
    rows = [r for c in range(8) for r in chat(rng, c, 90)]
    rows += chat(rng, None, 20) + chat(rng, 99, 6) * 3 + [(100, None, None, None), (101, 5, "user", "x" * 300_000 + "."), (101, 6, "assistant", "Same.")]
    rows += [(102, t, "assistant", "Same.") for t in range(40)] + [(103, 7, "user", "Copy.")] * 50
    plain = plain_damage(rows)
    for r in rows:
        plain[r[0]]  # every conversation is there, even if nothing of it is left
    want = {c: plain_report(own, by_rows) for c, own in plain.items()}
    assert reported(spark, rows) == want and reported(spark, rows, 1, 4) == want and reported(spark, rows, 4, 7) == want
    whole = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURN)
    turns = defaultdict(list)
    for r in cyk.repaired(cyk.damaged(whole), 16).collect():
        turns[r["conv_id"]].append((r["position"], r["role"], r["text"]))
    for c, own in want.items():
        text = "\n".join(f"{r}:{t}" for _, r, t in sorted(turns[c]))
        assert hashlib.sha256(text.encode()).hexdigest() == own[-1]
    assert reported(spark, [], 1) == {}


def test_all_rows_dropped(spark):
    turn = next(t for t in range(99) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert reported(spark, [(1, turn, "user", "Hi.")]) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_cut_of_a_span_gives_what_all_cuts_give():
    for rows in map("".join, product("xsuAo", repeat=5)):
        cells = {(i, i + 1): cyk.span(rows[i]) for i in range(5)}
        for size in range(2, 6):
            for i in range(6 - size):
                found = [cyk.combined(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
                assert len(set(found)) == 1
                cells[i, i + size] = found[0]
        assert cells[0, 5] == cyk.span(rows)


def test_conversations_of_the_tables(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    plain = plain_damage(rows)
    got = {r["conv_id"]: r["audit"] for r in queries.op11_conversation_cyk(spark, "/root/testdata/sf0.01").collect()}
    assert got == {c: by_rows(plain[c], faults(plain[c]))[1] for c in {r[0] for r in rows}}


# ---- exact copies


def test_trie_holds_and_spills():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 12))).encode() for _ in range(3000)] + [b"common " * 30 + str(i).encode() for i in range(50)]
    for most in (1 << 30, 20_000, 1):
        trie, found = exact_trie.Trie(most), defaultdict(lambda: [None, 0])
        out = []
        for i, t in enumerate(texts):
            trie.insert(t, i)
            out += list(trie.spilled())
            assert trie.held <= max(most, 1)
        for t, owner, n in [*out, *trie.terminals()]:
            found[t] = [max(owner, -1 if found[t][0] is None else found[t][0]), found[t][1] + n]
        assert {t: tuple(x) for t, x in found.items()} == {t: (max(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts)}


@pytest.mark.parametrize("most", [exact_trie.TRIE_BYTES, 2000])
def test_copies_against_plain(spark, most):
    rng = np.random.default_rng(4)
    texts = ["", None, "A", "a", "É", "é", "Straße", "x" * 300_000, "X" * 300_000, "K", "K", "same text", "Same Text", "same text "]
    rows = [(int(i), texts[rng.integers(len(texts))]) for i in rng.permutation(300)] + [(5, "a"), (5, "a"), (None, "a"), (None, "only"), (7, "a"), (None, "only")]
    table = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOC).repartition(5)
    low = lambda t: (t or "").translate(LOWER)
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    want = []
    for i, t in rows:
        keep = max((x for x in groups[low(t)] if x is not None), default=None)
        want.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert sorted(map(tuple, exact_trie.membership(table, most).collect()), key=repr) == sorted(want, key=repr)
    assert exact_trie.membership(table.where("false")).count() == 0


def test_copies_same_as_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_trie.oracle()}) AS x").fetchall())
    assert sorted(map(tuple, queries.op12_patricia_owners(spark, "/root/testdata/sf0.01").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want


# ---- spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others and words[v := min(others, key=lambda v: (-words[v], v))] >= 10 * words[w]:
            form[w] = v
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("long", [64, 8])
def test_variants_against_all_pairs(spark, monkeypatch, long):
    monkeypatch.setattr(spelling_permuterm, "LONG", long)
    rng = np.random.default_rng(5)
    alphabet = list("aabbéÿ")
    pool = ["".join(rng.choice(alphabet, rng.integers(6, 10))) for _ in range(400)]
    often = [1, 2, 2, 3, 25, 30, 400]
    rows = [(i % 97, " ".join([w] * often[rng.integers(len(often))])) for i, w in enumerate(pool)]
    rows += [(1, None), (None, "Übermäßig übermäßig ÜBERMÄßIG"), (2, ""), (3, "a" * 20_000 + " " + "a" * 20_000 + " b" + "a" * 19_999 + " b" + "a" * 19_999), (4, "x×y÷zab-x×y÷zab")] + [(9, "hhhhhhhh hhhhhhh hhhhhhhh hhhhhhh")] * 3 + [(8, " ".join(["kettena"] * 2 + ["kettenab"] * 25 + ["kettenabc"] * 400))]
    table = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOC).repartition(4)
    got = spelling_permuterm.variants(table, typo_every=31).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain_variants(plain_words(rows))
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want and any(r[1] and r[2] != r[1] for r in want)
    assert spelling_permuterm.variants(table.where("false"), typo_every=31).count() == 0


def test_long_chains_end(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(19)]
    got = dict(map(tuple, spelling_permuterm.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {f"w{i}": "w19" for i in range(19)}


def test_variants_of_the_tables(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = queries.op13_permuterm_spelling(spark, "/root/testdata/sf0.001").select("word", "form", "root", "n", "n_near", "form_n").collect()
    words = plain_words(rows)
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    some = sorted(words)[::40]
    want = {w: sum(one_edit(w, v) for k in (-1, 0, 1) for v in by_size[len(w) + k]) for w in some}
    assert {r["word"]: r["n"] for r in got} == words
    assert {r["word"]: r["n_near"] for r in got if r["word"] in want} == want
