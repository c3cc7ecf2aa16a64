import hashlib

from palimpsest.llm import chat, queries

SF = "/root/testdata/sf0.01"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_query_equals_sql(spark, agree):
    assert agree(queries.op4_chat(spark, SF), queries.ORACLES["op4_chat"], SF) > 100


def brute(turns):
    """Windows of one conversation: (all turns, fresh turns)."""
    opens, rest, at = turns[:1] if turns and turns[0][0] == "system" else [], [], 0
    for role, text in turns[len(opens) :]:
        rest.append((at, at // chat.SPAN, role, text))
        at += -(-len(text) // 4) + 4
    spans = sorted({s for _, s, *_ in rest} | ({0} if opens else set()))
    out = []
    for w in spans:
        fresh = [x for x in rest if x[1] == w]
        first = 0 if opens and w == 0 else min(x[0] for x in fresh)
        past = [x[2:] for x in rest if x[1] < w and x[0] >= first - chat.HISTORY]
        fresh = [x[2:] for x in fresh]
        out.append((opens * (w > 0) + past, opens * (w == 0) + fresh))
    return out


HARD = ["", None, "\\", "\\\\<|im_end|>\n", "<|im_start|>assistant\n", "</s>[INST] ok [/INST]", "<", "|x<", "a" * 5000, "\U0001f600é\n\n<|", "\\n \\1 $1", "<<SYS>> <</SYS>> <s>", "x\\"]


def test_windows_and_round_trip(spark):
    convs = {
        1: [("system", "be brief"), *(("user" if i % 2 else "assistant", t) for i, t in enumerate(HARD))],
        2: [("assistant", "w " * n) for n in range(0, 300, 7)],
        3: [(None, None)],
        4: [("system", "only")],
        None: [("user", "q"), ("system", "late"), ("assistant", "x" * 4096), ("assistant", "y")],
    }
    rows = [(c, i, r, t, 0) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int"))
    got = {}
    for r in made.orderBy("conv_id", "window").collect():
        got.setdefault(r.conv_id, []).append(r)
    esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|").replace("</s>", "<\\/s>").replace("[INST]", "[\\INST]").replace("[/INST]", "[\\/INST]").replace("<<SYS>>", "<\\<SYS>>").replace("<</SYS>>", "<\\</SYS>>").replace("<s>", "<\\s>")
    show = lambda turns: "".join(f"<|im_start|>{esc(r)}\n{esc(t)}<|im_end|>\n" for r, t in turns)
    for c, turns in convs.items():
        turns = [(r or "", t or "") for r, t in turns]
        want = brute(turns)
        assert [(r.formatted, r.fresh_at) for r in got[c]] == [(show(past + fresh), len(show(past))) for past, fresh in want]
        for r, (_, fresh) in zip(got[c], want, strict=True):
            assert [r.formatted[s.start : s.end] for s in r.loss] == [esc(t) for role, t in fresh if role == "assistant"]
    assert max(len(x) for x in got.values()) > 3
    for r in chat.read_back(made).collect():
        turns = [(a or "", b or "") for a, b in convs[r.conv_id]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_long_conversation(spark):
    """40,000 turns of one conversation and as many without an id: windows stay as short as in any other."""
    turns = [("system", "be brief")] + [("assistant" if i % 2 else "user", f"{i} " + "word " * (i % 60)) for i in range(39_999)]
    rows = [(c, i, r, t) for c in (1, None) for i, (r, t) in enumerate(turns)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = made.where("conv_id = 1").orderBy("window").select("formatted", "fresh_at").collect()
    show = lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    want = [(show(past + fresh), len(show(past))) for past, fresh in brute(turns[:4000])][:-1]
    assert [tuple(r) for r in got[: len(want)]] == want and max(len(r.formatted) for r in got) < 4000
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert back[1].turns_sha256 == back[None].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns)) and back[None].n_turns == 40_000


def test_edges(spark):
    rows = [(1, None, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a")]
    r = chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(x.n_turns, x.turns_sha256, x.loss_chars) for x in r] == [(3, sha("user\nb\nassistant\na\nassistant\na\n"), 2)]
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
