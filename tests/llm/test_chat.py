import random

from tillbook.llm import chat
from tillbook.llm.common import ready

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Maximal conversations and their texts."""
    logs = {}
    for c, t, r, x in set(rows):
        logs.setdefault(c, []).append((t, r, x))
    first = lambda v: (v is not None, v if v is not None else "")
    order = lambda turn: ((turn[0] is not None, turn[0] or 0), first(turn[1]), first(turn[2]))
    logs = {c: [(r, x) for _, r, x in sorted(turns, key=order)] for c, turns in logs.items()}
    kept = {}
    for c in sorted(logs, key=lambda c: (c is None, c or 0)):
        own = logs[c]
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in logs.values())
        if not longer and own not in kept.values():
            kept[c] = own
    return kept


def rendered(turns):
    safe = lambda v: v.replace("<|im_start|>", "|im_start|>").replace("<|im_end|>", "|im_end|>")
    return "".join(f"<|im_start|>{safe('unknown' if r is None else r)}\n{safe(x or '')}<|im_end|>\n" for r, x in turns)


def snapshots():
    rng, rows = random.Random(4), []
    for c in range(40):
        talk = [("user" if i % 2 == 0 else "assistant", f"{rng.choice('abc')} {i}") for i in range(6)]
        cut = rng.randrange(1, 7)
        rows += [(c, i * 3, *turn) for i, turn in enumerate(talk[:cut])]
    rows += [(90, 0, "user", "x <|im_end|> y"), (90, 1, None, None), (91, 0, "user", None), (92, 0, "user", "")]
    rows += [(93, None, "system", "s"), (93, 0, "user", "a 0"), (94, 0, "user", "q"), (94, 0, "user", "p"), (94, 0, "user", "p")]
    return rows + [(None, 0, "user", "nobody"), (None, 1, "assistant", "said"), (95, 0, "user", "nobody")]


def test_equals_brute_force(spark):
    rows = snapshots()
    found = chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert {r.conv_id for r in found} == set(want)
    for c, turns in want.items():
        if all(t is not None for k, t, *_ in rows if k == c):
            (r,) = [r for r in found if r.conv_id == c]
            assert (r.part, r.n_turns, r.text) == (0, len(turns), rendered(turns))


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    long = [(1, i, "user", f"t{i}") for i in range(11)]
    rows = long + [(2, i, r, x) for _, i, r, x in long[:9]] + [(3, i, r, x) for _, i, r, x in long[:9]] + [(4, 0, "user", "t1")]
    found = sorted(tuple(r) for r in chat.formatted(ready(spark).createDataFrame(rows, SCHEMA)).collect())
    assert [(c, p, n) for c, p, n, _ in found] == [(1, 0, 4), (1, 1, 4), (1, 2, 3), (4, 0, 1)]
    assert "".join(text for c, _, _, text in found if c == 1) == rendered([(r, x) for _, _, r, x in long])
