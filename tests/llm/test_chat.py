import random
from hashlib import sha256

from skylathe.llm import chat

PARTS = ["\\", "###", "</turn>", "\n", "a", " ", "#", "<", "\\###", "<|x|>", "### assistant\n", "é", "word word"]


def test_escapes_are_reversible():
    rng = random.Random(5)
    for _ in range(3000):
        turns = [("".join(rng.choices(PARTS, k=rng.randint(0, 5))), "".join(rng.choices(PARTS, k=rng.randint(0, 12)))) for _ in range(rng.randint(1, 4))]
        pieces = [chat.written(*t) for t in turns]
        assert chat.read("".join(p for p, _, _ in pieces)) == turns
        assert [chat.unescape(p[a:b]) for p, a, b in pieces] == [t for _, t in turns]


def digests(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()


def test_conversations(spark):
    rng = random.Random(6)
    convs = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")], None: [("user", None), (None, "x")]}
    for c in range(40):
        turns = [("system", "be brief " * rng.choice([1, 30]))] * rng.randint(0, 1)
        for _ in range(rng.choice([1, 4, 60])):
            turns.append((rng.choice(["user", "assistant", "system"]), " ".join(rng.choices(PARTS, k=rng.choice([0, 5, 80, 300])))))
        convs[c] = turns
    convs[50] = [("assistant", "w " * 40_000), ("user", ""), ("assistant", "é")]
    rows = [(c, i, r, t, "f") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    windows = chat.format_chats(table)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == {c: digests(t) for c, t in convs.items()}
    for w in windows.collect():
        turns = chat.read(w.formatted)
        tokens = [len(t.split()) + 1 for _, t in turns]
        fresh = len(turns) - w.repeated
        assert fresh >= 1
        system = convs[w.conv_id][0][0] == "system"
        if fresh > 1:
            assert sum(tokens) <= chat.BUDGET or (system and w.window == 0) or tokens[0] > chat.BUDGET
        if w.window and system:
            assert turns[0] == convs[w.conv_id][0] and w.repeated >= 1
        assert w.repeated - (system and w.window > 0) <= chat.HISTORY_TURNS
        assert not w.window or not w.repeated - (1 if system else 0) or sum(tokens[1 if system else 0 : w.repeated]) <= chat.HISTORY_TOKENS


def test_ties_and_empty(spark):
    table = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(table)).first().turns_sha256 == digests([("user", "a"), ("user", "a"), ("user", "b")])[1]
    assert chat.read_back(chat.format_chats(table.limit(0))).count() == 0
