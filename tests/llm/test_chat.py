import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from concord.llm import chat


@given(st.text(alphabet="<|\\im_end>\nab", max_size=30))
def test_escape_round_trip(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = [x for _, _, r, x in turns if r == "assistant"]
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    return out


def test_windows_read_back(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(30), None]:
        n = 300 if c == 0 else rng.randint(1, 12)
        for t in range(n):
            role = "system" if t == 0 and (c == 0 or rng.random() < 0.5) else rng.choice(["user", "assistant", "to\nol", None])
            rows.append((c, t, role, rng.choice([None, "", "<|im_end|>\n<|im_start|>assistant", "wörd " * rng.randint(1, 40), "a<\\|b"])))
    rows += [(5, 1, "user", "again"), (5, 1, "user", "again"), (6, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS window")
    windows = chat.windows(df, budget=60, history=3, overhead=2)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == expected(rows)
    for r in windows.collect():
        turns = chat.read_window(r["formatted"])
        assert len(turns) == r["n_history"] + r["n_new"] and r["n_new"] > 0
        assert r["n_tokens"] <= 60 or r["n_new"] == 1
        for span in r["loss"]:
            assert any((a, b) == (span["start"], span["end"]) and role == "assistant" for role, _, a, b in turns[r["n_history"] :])
    by = {}
    for r in windows.orderBy("conv_id", "window").collect():
        by.setdefault(r["conv_id"], []).append(r)
    retained = 0
    for found in by.values():
        read = [[t[:2] for t in chat.read_window(r["formatted"])] for r in found]
        system = read[0][0] if read[0][0][0] == "system" else None
        said = []
        for r, turns in zip(found, read, strict=True):
            old, new = turns[: r["n_history"]], turns[r["n_history"] :]
            assert r["first_turn"] == len(said)
            if r["window"] and system:
                assert old[0] == system
                old, retained = old[1:], retained + 1
            past = said[1:] if system else said
            assert len(old) <= 3 and old == past[len(past) - len(old) :]
            said += new
    assert retained > 5


def plain_windows(turns, budget, history):
    """Tokens, history and new turns of each window, by sums over lists; turns: role and tokens."""
    out, done = [], 0
    while done < len(turns):
        system = [0] if done and turns[0][0] == "system" else []
        old = []
        for k in reversed(range(turns[0][0] == "system", done)):
            if len(old) == history or sum(turns[j][1] for j in [*system, k, *old]) > budget // 2:
                break
            old = [k, *old]
        size = lambda *parts: sum(turns[k][1] for part in parts for k in part)
        new = [done]
        if size(system, old, new) <= budget:
            while new[-1] + 1 < len(turns) and size(system, old, new, [new[-1] + 1]) <= budget:
                new.append(new[-1] + 1)
        else:
            old = []
        out.append((size(system, old, new), system + old, new))
        done = new[-1] + 1
    return out


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(0, 9)), min_size=1, max_size=25), st.integers(1, 20), st.integers(0, 4))
def test_windows_of_turns(turns, budget, history):
    state, rows = chat._Conversation(budget, history), []
    for k, (role, tokens) in enumerate(turns):
        if done := state.add(role, f"{k}", tokens):
            rows.append(done)
    rows.append(state.window(True))
    got = []
    for r in rows:
        places = [int(t[1]) for t in chat.read_window(r["formatted"])]
        got.append((r["n_tokens"], places[: r["n_history"]], places[r["n_history"] :]))
    assert got == plain_windows(turns, budget, history)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.windows(df)).count() == 0
