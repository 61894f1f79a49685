"""Chat formatting and the prefix trie against plain versions, and on edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelab.llm import chat, prefix_trie
from storelab.llm.parens import Parens

SCHEMA = "conv_id long, turn long, role string, text string, code string, tie long, chars int, `key` string, kind string"
MARKS = "a \\l </turn> <turn> \\\\<text>\\ <|endoftext|> é漢 end."


def extra(rows):
    return [(*r, "code", 1, 2, "key", "kind") for r in rows]


@pytest.fixture(scope="module")
def told(spark):
    rng = np.random.default_rng(5)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", MARKS), (1, 2, "assistant", "<turn>"), (2, None, None, None), (2, 0, "assistant", ""),
            (2, 0, "assistant", ""), (2, 0, "user", "b"), (2, 0, "user", "a"), (None, 3, "assistant", "alone"), (None, 1, "user", "first"),
            (3, 5, "as</turn>sistant", "x"), (7, 1, "assistant", " \n lead"), (100, 0, "system", "same"), (100, 1, "user", "u"),
            (200, 0, "system", "same"), (200, 1, "user", "u"), (200, 2, "assistant", "yes"), (-7, 0, "user", MARKS)]
    long = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 8))) for _ in range(30_000))
    rows += [(5, 0, "assistant", long), (5, 1, "user", "short"), (5, 2, "assistant", long[::-1] + "\n\n" + "x" * 200_000)]
    rows += [(6, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 9)) for i in range(120)]
    rows += [(1000 + c, t, "user", "one text") for c in range(60) for t in range(c % 4 + 1)]
    rows += [(1100 + c, t, "user", f"{c % 3 if t > 2 else 0}") for c in range(90) for t in range(c % 7)]
    return spark.createDataFrame(extra(rows), SCHEMA).repartition(7)


def sequences(df):
    """Turns of each conversation in order."""
    by = defaultdict(list)
    for r in df.select("conv_id", "turn", "role", "text").collect():
        role, text = r.role or "", r.text or ""
        code = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        by[r.conv_id].append(((r.turn is not None, r.turn or 0, code), role, text))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in by.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digests(df):
    out = {}
    for c, turns in sequences(df).items():
        said = "".join(t for r, t in turns if r == "assistant")
        rendered = "".join(f"<turn>{chat.escaped(r)}<text>{chat.escaped(t)}</turn>" for r, t in turns)
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(rendered))
    return out


def digests(df):
    rows = chat.chat_digests(df).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_chat_digests(told):
    assert digests(told) == plain_digests(told)


def test_chat_pieces(told, monkeypatch):
    """Small pieces and slices give the same digests and the same ids."""
    whole = chat.formatted(told.where("conv_id in (1, 5)")).orderBy("conv_id", *chat.ORDER).collect()
    monkeypatch.setattr(chat, "PIECE_CHARS", 100)
    assert digests(told) == plain_digests(told)
    monkeypatch.setattr(chat, "SLICE_CHARS", 1000)
    cut = chat.formatted(told.where("conv_id in (1, 5)")).orderBy("conv_id", *chat.ORDER).collect()
    assert len(cut) > len(whole)

    def ids(rows, c):
        return [i for r in rows if r.conv_id == c for i in r.ids]

    assert ids(cut, 1) == ids(whole, 1) and ids(cut, 5) == ids(whole, 5)


def test_ids_say_the_text(told):
    encoder = chat.ChatEncoder()
    for r in chat.formatted(told.where("conv_id < 8")).collect():
        assert encoder.tokenizer.decode(r.ids, skip_special_tokens=False) == r.rendered
        turns = chat.parse(r.rendered)
        said = [i for i, on in zip(r.ids, r.loss) if on]
        assert encoder.tokenizer.decode(said, skip_special_tokens=False) == "".join(chat.escaped(t) for role, t in turns if role == "assistant")


def test_escapes():
    for text in (MARKS, "\\", "\\\\l", "<", "<turn", "</turn></turn>", "", "<<turn>turn>"):
        made = chat.escaped(text)
        assert chat.unescaped(made) == text and not any(m in made for m in (chat.TURN, chat.TEXT, chat.END))


def test_masks_by_search():
    rng = np.random.default_rng(3)
    for _ in range(50):
        cuts = np.unique(rng.integers(0, 60, 12))
        spans = [(int(a), int(b), bool(rng.integers(0, 2))) for a, b in zip(cuts[:-1], cuts[1:])]
        at = np.sort(rng.integers(0, 60, 30))
        ends = at + rng.integers(1, 4, 30)
        plain = [any(on and a <= s and e <= b for a, b, on in spans) for s, e in zip(at, ends)]
        assert chat.loss_mask(at, ends, spans).tolist() == plain


# --- trie ---------------------------------------------------------------------------

def rebuilt(df):
    own = {c: t for c, t in sequences(df.where("conv_id is not null")).items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(made):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    return {(own[0], len(p)): (members[p[:-1]][0] if p else None, len(own), children[p], leaves[p], saved[p], sha(",".join(map(str, ends[p]))))
            for p, own in members.items()}


def trie_rows(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_rebuilt(told):
    def code(turn):
        return hashlib.md5(f"{len(turn[0].encode())}:{turn[0]}{turn[1]}".encode()).digest()
    found = {r.conv_id: (bytes(r.key), list(r.chars)) for r in prefix_trie.rebuilt(told).collect()}
    assert found == {c: (b"".join(map(code, t)), [len(x[1]) for x in t]) for c, t in rebuilt(told).items()}


def test_trie(told):
    made = rebuilt(told)
    assert any(not t for t in made.values()) or min(map(len, made.values())) >= 0
    assert trie_rows(prefix_trie.conversation_trie(told)) == plain_trie(made)


@pytest.mark.parametrize("nodes,paths", [(1, 2), (9, 2), (60, 5)])
def test_trie_of_small_shards(told, nodes, paths):
    """Several levels of spines give the same nodes as one shard."""
    df = told.where("conv_id <> 6")
    assert trie_rows(prefix_trie.trie(prefix_trie.rebuilt(df), nodes, paths)) == plain_trie(rebuilt(df))


def test_one_conversation_with_a_third_of_the_rows(spark, told):
    df = told.where("conv_id in (6, 1)").unionAll(told.where("conv_id = 6").withColumn("conv_id", F.lit(106).cast("long")))
    assert trie_rows(prefix_trie.trie(prefix_trie.rebuilt(df), 50, 2)) == plain_trie(rebuilt(df))


def test_empty_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.chat_digests(empty).collect() == [] and prefix_trie.conversation_trie(empty).collect() == []
    lost = spark.createDataFrame(extra([(None, 1, "user", "x")]), SCHEMA)
    assert prefix_trie.conversation_trie(lost).collect() == []


def test_parens():
    rng = np.random.default_rng(1)
    for n in (1, 2, 31, 32, 33, 64, 500, 5000):
        for deep in (0.3, 0.5, 0.9, 1.0):
            bits, excess, left = [], 0, n
            while left or excess:
                up = left and (excess == 0 or rng.random() < deep)
                bits.append(int(bool(up)))
                excess += 1 if up else -1
                left -= bool(up)
            stack, close = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            bits = np.array(bits, np.uint8)
            tree, opens = Parens(bits), np.flatnonzero(bits)
            assert tree.find_close(opens).tolist() == [close[i] for i in opens]
            assert tree.rank(np.arange(len(bits) + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
