import random

import numpy as np
import pytest

from rankloom.llm.chat import format_conversations, masked_text, masked_tokens, read_back, render
from rankloom.llm.op3_chat import TOKENIZER

PIECES = ["[INST]", "[/INST]", "</s>", "\\", "<", "[", "/", "s>", "é", "漢字", "😀", " ", "\n", "ok", "INST]", "<|endoftext|>", ""]


@pytest.mark.parametrize("seed", range(30))
def test_round_trip(seed):
    draw = random.Random(seed)
    turns = [(draw.choice(["user", "assistant", "", "[INST]", "a\\"]), "".join(draw.choices(PIECES, k=draw.randint(0, 12)))) for _ in range(6)]
    text, spans = render(turns, frozenset(["assistant"]))
    assert read_back(text) == turns
    assert len(spans) == sum(r == "assistant" for r, _ in turns)


def test_mask_is_the_intersection():
    starts = np.array([0, 3, 3, 5, 9])
    ends = np.array([3, 5, 5, 9, 10])
    for spans in ([(3, 5)], [(0, 3), (5, 9)], [(4, 6)], [(2, 2)], []):
        want = [any(a < b and a < e and s < b for a, b in spans) for s, e in zip(starts, ends)]
        assert masked_tokens(starts, ends, spans).tolist() == want


def test_odd_rows(spark):
    rows = [
        (1, 1, "assistant", " leading and trailing "), (1, 0, "user", None), (1, 2, None, "no role"), (1, None, "assistant", "late\n\n"),
        (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "assistant", "x </s> 漢字😀"), (3, 0, "assistant", "a" * 200_000),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").selectExpr("*", "1 as formatted", "2 as turns")
    got = {r.conv_id: r for r in format_conversations(df, TOKENIZER).collect()}
    assert set(got) == {1, 2, 3, None}
    assert read_back(got[1].formatted) == [("user", ""), ("assistant", " leading and trailing "), ("", "no role"), ("assistant", "late\n\n")]
    assert masked_text(got[1].formatted, got[1].token_start, got[1].token_end, got[1].loss_mask) == " leading and trailing late\n\n"
    assert got[2].n_turns == 2 and not any(got[2].loss_mask)
    for key, text in ((None, "x </s> 漢字😀"), (3, "a" * 200_000)):
        assert masked_text(got[key].formatted, got[key].token_start, got[key].token_end, got[key].loss_mask) == text
    assert format_conversations(df.limit(0), TOKENIZER).count() == 0
