import pytest
from helpers import LONG, docs_frame, with_odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from ostinato.llm import token_counts

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
TEXTS = ["Hello, world's BEST  'test' 12", None, "", "<|endoftext|> a <|startoftext|>b", "<|ENDOFTEXT|>", "İstanbul Σίσυφος — “q” …", "日本語 テキスト 😀", "áb é É ß ſ",
         "tab\tnl\n\x1c\x85\xa0x", LONG, "x" * 5000, "don't we'll they're", " ", "½²3"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(spark, library):
    docs = with_odd_rows(docs_frame(spark, TEXTS, {"n_tokens": 0, "over_limit": "x"}), spark)
    rows = token_counts.count_tokens(docs, PATH, frequent=8, per_task=8, bound=20).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 2048)
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_parts_change_nothing(library):
    table = token_counts.Lengths(PATH, None, 1000)
    text = "Some words, é and 12 more. " * 50
    assert sum(table.count(p) for p in token_counts.parts(text, 37)) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from("'’“…—sStTrReEvVlLdDmM <|>")), max_size=40))
def test_any_latin_text(library, text):
    assert token_counts.Lengths(PATH, None, 1000).count(text) == len(library.encode(text, add_special_tokens=False).ids)
