import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from quirelake.llm.packing import op7_tokenizer
from quirelake.llm.tokens import PieceTokenizer

TEXTS = [
    "end of page <|endoftext|> next", "<|endoftext|>", "a<|startoftext|>b", "x <|startoftext|>, y. <|endoftext|>\nz", "<|ENDOFTEXT|> and <|EndOfText|> here", "<|endoftext|≯ composed",
    "<|endoftext |> apart", "<|endoftext|>" * 3, "tab\t<|endoftext|>\t\x1c end", "plain words only, as before. Yes.", "", " ", "Été ΣΑΣ <|endoftext|>", "ΣΑΣ, ΟΔΟΣ. İ, İI. J̌ H̱ T̈ K Å",
    "it's we'll 'tis, (a) (b). x), y!? don't. l'été, 12, 3.5. a1, é, ß. ǅ, µ. ª,",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(op7_tokenizer())


def ids(mine, text):
    return np.frombuffer(mine.encoded(text), f"<u{mine.width}").tolist()


@pytest.mark.parametrize("memory", [3, 400_000])
def test_texts_with_added_tokens(plain, memory):
    mine = PieceTokenizer(op7_tokenizer(), memory)
    got = [ids(mine, t) for t in TEXTS]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert 49407 in got[0] and len(got[0]) == 5 and len(mine) <= memory


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(plain, seed):
    """Thousands of short texts over letters, signs, marks and spaces of many scripts."""
    rng = random.Random(seed)
    letters = [*"abcXYZ'.,;:!?()[]<|>-_09 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0", *"éÉßµªºÀñÑøØÞþİıŒœǅǰΣσςΑάЖжאب中文あア가", "́", "̌", "̇", "​", " ", "　", "K", "Å", "😀", "👍🏽", "'s", "'LL", "ﬁ", "Ⅷ", "²", "½", "٣"]
    mine = PieceTokenizer(op7_tokenizer(), 500)
    for _ in range(2500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert ids(mine, text) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_kinds_are_refused(tmp_path):
    raw = open(op7_tokenizer(), encoding="utf-8").read()
    path = tmp_path / "other.json"
    path.write_text(re.sub(r'"type":\s*"Lowercase"', '"type": "NFKC"', raw, count=1), encoding="utf-8")
    with pytest.raises(ValueError):
        PieceTokenizer(str(path))
