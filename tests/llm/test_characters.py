"""Both tokenizers against the library on every code point."""

from tokenizers import Tokenizer

from freshet.llm import bpe, queries, token_counts

POINTS = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
#: Around each character: alone, inside letters, digits and marks, doubled, after an apostrophe.
FORMS = ["{0}", "a{0}b", "1{0}1", "#{0}#", "{0}{0}", "'{0}"]
#: Characters of one text.
TOGETHER = 64


def texts(points):
    for i in range(0, len(points), TOGETHER):
        yield "\n".join(f.format(chr(p)) for p in points[i : i + TOGETHER] for f in FORMS)


def telling():
    """Every code point below U+3400 and every 16th beyond, and all that the library and Python may know otherwise."""
    known = bpe.characters.tables()
    edges = {p for name in ("letters", "numbers", "differing") for a, b in known[name] for p in (a - 1, a, b - 1, b)}
    chosen = set(range(0x3400)) | set(range(0x3400, 0x110000, 16)) | edges | {ord(c) for c in known["lower"]}
    return [p for p in POINTS if p in chosen]


def test_ids_on_every_kind_of_code_point():
    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        coder = bpe.WordBpe(f.read())
    given = list(texts(telling()))
    expected = library.encode_batch(given, add_special_tokens=False)
    wrong = [t for t, got, e in zip(given, coder.encode(given).to_pylist(), expected) if got != e.ids]
    assert not wrong


def test_counts_on_every_kind_of_code_point():
    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        counter = token_counts.Counter(f.read())
    given = list(texts(telling()))
    expected = library.encode_batch(given, add_special_tokens=False)
    wrong = [t for t, got, e in zip(given, counter.count(given), expected) if got != len(e.ids)]
    assert not wrong
