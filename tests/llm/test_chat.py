"""Formatting and reading back."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import chat_format as C

TEXT = st.lists(st.one_of(st.sampled_from([*C.INST.controls, "\\", "-", "<", "/s>", "[", "INST]", " ", "\n", "é", "🙂", "[OUT] ", " </s>\n"]), st.text(max_size=3)), max_size=12).map("".join)
ROLE = st.sampled_from(["system", "user", "assistant", "tool", "", "[/ROLE]"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_round_trip(turns):
    segments = [s for role, text in turns for s in C.segments_of(role, text)]
    assert C.parse("".join(s for s, _ in segments)) == turns
    reader = C.Reader()
    assert [t for s, _ in segments if (t := reader.feed(s))] == turns
    assert "".join(C.unescape(s) for s, loss in segments if loss) == "".join(t for r, t in turns if r == "assistant")
    for _, text in turns:
        assert not any(c in C.escape(text) for c in C.INST.controls)


def test_machine():
    def valid(*roles):
        m = C.Machine()
        for r in roles:
            m.step(r)
        return m.end()

    assert valid("system", "user", "assistant") and valid("user") and valid("user", "assistant", "user")
    assert not any([valid(), valid("system"), valid("assistant"), valid("user", "user"), valid("user", "system"), valid("user", "tool")])


def test_query(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "assistant", "🙂c"), (2, 0, None, "x"), (None, 0, "user", "n"), (3, None, "user", "a"), (3, 0, "assistant", "y" * 100_000)]
    got = {r.conv_id: r for r in C.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -7}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256, got[1].valid) == (3, sha("user\n\nassistant\nb\nassistant\n🙂c\n"), 3, sha("b🙂c"), False)
    assert got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[-7].valid
    assert got[2].turns_sha256 == sha("\nx\n") and got[3].loss_chars == 100_000 and got[3].valid


def test_empty(spark):
    got = C.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [r.conv_id for r in got] == [-7]
