import hashlib
import random

from tidemill.llm import chat

COLUMNS = "conv_id long, seq long, kind string, turn long, role string, text string, n_turns string"


def test_control_strings_are_reversible():
    for t in ("", "<|im_end|>", "<\\|im_start|>", "<\\\\|x", "a<|", "|<|\\|", "plain\n<|im_end|>\n<|im_start|>assistant\nhi"):
        assert chat.unescape(chat.escape(t)) == t
        assert "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def folded(spark, events):
    df = spark.createDataFrame([(*e, "x") for e in events], COLUMNS)
    out = {}
    for r in sorted(chat.format_chats(df).collect(), key=lambda r: (r.conv_id or -9, r.part)):
        out.setdefault(r.conv_id, []).extend(chat.read(r.formatted))
    return out


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, "message", 0, "user", "hel"), (1, 1, "delta", 0, None, "lo"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, "assistant", "bad"),
        (1, 4, "message", 2, "user", "gone"), (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "go"), (1, 7, "delta", 1, None, "od"), (1, 8, "message", 2, "user", "next"),
        (2, 0, "message", 0, "user", "one"), (2, 1, "message", 1, "assistant", "two"), (2, 2, "edit", 0, None, "uno"), (2, 3, "message", 1, "assistant", "dos"),
        (3, 5, None, None, None, None), (None, 1, "message", 1, "user", "n"), (4, 1, "message", 1, "user", "same"), (4, 1, "message", 1, "user", "same"),
        (5, 1, "edit", 0, "user", "alone"),
    ]
    assert folded(spark, events) == {
        1: [("user", "hello"), ("assistant", "good"), ("user", "next")], 2: [("user", "uno"), ("assistant", "dos")],
        3: [("", "")], None: [("user", "n")], 4: [("user", "same")] * 2, 5: [("user", "alone")],
    }
    assert folded(spark, []) == {}


def test_digest_reads_long_conversations_back(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 50)
    said = [("user" if i % 2 == 0 else "assistant", f"t{i} <|im_end|>" + "é" * (i * 3)) for i in range(40)]
    rows = [(7, i, r, t) for i, (r, t) in enumerate(said)] + [(8, 0, "assistant", None), (9, 0, None, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(chat.from_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in said if r == "assistant")
    assert (got[7].n_turns, got[7].turns_sha256) == (40, sha("".join(f"{r}\n{t}\n" for r, t in said)))
    assert (got[7].loss_chars, got[7].loss_sha256) == (len(loss), sha(loss))
    assert (got[8].n_turns, got[8].turns_sha256, got[8].loss_chars) == (1, sha("assistant\n\n"), 0)
    assert got[9].formatted_chars == 3_000_000 + len("<|im_start|>\n<|im_end|>\n")


def plain_fold(events):
    """Each conversation's log one event after the other."""
    out = {}
    for conv, _, kind, turn, role, text in sorted(events, key=lambda e: e[1]):
        turns = out.setdefault(conv, {})
        if kind in ("edit", "regenerate"):
            for later in [t for t in turns if t > turn]:
                del turns[later]
        now = turns.setdefault(turn, {"role": "", "messages": []})
        now["role"] = role or now["role"]
        if kind == "message" or not now["messages"]:
            now["messages"].append([role if kind == "message" else now["role"], text])
        elif kind == "delta":
            last = now["messages"][-1]
            last[0], last[1] = last[0] or now["role"], last[1] + text
        else:
            now["messages"] = [[now["role"], text]]
    return {c: [tuple(m) for t in sorted(turns) for m in turns[t]["messages"]] for c, turns in out.items()}


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.stretch, r.part)):
        out.setdefault(r.conv_id, []).extend(chat.read(r.formatted))
    return out


def test_random_logs_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(chat, "BITS", 2)
    draw = random.Random(5)
    events = []
    for conv in range(6):
        top = 0
        for seq in range(400 if conv == 3 else 30):  # one conversation has most of the rows
            top = max(0, top + draw.choice((1, 1, 1, 0, -1)))
            back = draw.random() < 0.1
            kind = draw.choice(("edit", "regenerate")) if back else draw.choice(("message", "delta"))
            turn = draw.randrange(-2, top + 1) if back else top
            events.append((conv, seq, kind, turn, draw.choice(("user", "assistant")) if kind == "message" else draw.choice((None, "user")), f"<{seq}|"))
    rows = chat.format_chats(spark.createDataFrame([(*e, "x") for e in events], COLUMNS)).collect()
    assert in_order(rows) == plain_fold(events)
    assert len({r.stretch for r in rows if r.conv_id == 3}) > 5


def test_the_log_of_a_long_conversation_discards_answers_and_is_split(spark, monkeypatch):
    monkeypatch.setattr(chat, "BITS", 3)
    said = [("system", "s"), *[("user" if i % 2 else "assistant", f"turn {i}") for i in range(1, 60)]]
    turns = spark.createDataFrame([(1, 3 * i, r, t) for i, (r, t) in enumerate(said)] + [(1, None, "user", "no turn")], "conv_id long, turn long, role string, text string")
    log = chat.from_turns(turns)
    assert log.where("text = 'answer to a draft'").count() == 31
    rows = chat.format_chats(log).collect()
    assert in_order(rows) == {1: [("user", "no turn"), *said]}
    assert len({r.stretch for r in rows}) == 8
    got = chat.digest(chat.format_chats(log)).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 61)]
    assert got[0].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in [("user", "no turn"), *said]).encode()).hexdigest()


def test_an_edit_of_a_null_turn_discards_all_others_and_none_discards_it(spark):
    events = [(1, 0, "message", None, "user", "a"), (1, 1, "message", 0, "assistant", "b"), (1, 2, "edit", None, None, "c"), (1, 3, "message", 5, "assistant", "d"), (1, 4, "edit", 5, None, "e")]
    assert folded(spark, events) == {1: [("user", "c"), ("assistant", "e")]}
