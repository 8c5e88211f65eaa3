import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_keep_order_and_duplicates(spark):
    assert one(spark, text.tokenize(F.lit("The_foo bar-bar x é 42 Ça"))) == ["the_foo", "bar", "bar", "é", "42", "ça"]


def test_keywords_drop_stop_words_and_short_ones(spark):
    assert one(spark, text.keywords(F.lit("where is the_parser for HTTP or a b2"))) == ["parser", "http"]


@pytest.mark.parametrize(
    "word, stem",
    [("extraction", "extract"), ("extractor", "extract"), ("extracting", "extract"), ("implementation", "implement"), ("bus", "bus"), ("cat", "cat"), ("s", "s"), ("cats", "cat")],
)
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem == text.stem_word(word)


@pytest.mark.parametrize("value, n", [("", 1), ("   ", 1), ("a_b c", 2), ("f(x) + 1;", 7)])
def test_estimate(spark, value, n):
    from lodestone.embed import estimate

    assert one(spark, text.estimate_tokens(F.lit(value))) == n == estimate(value)


def test_truncate_bytes_ends_between_characters(spark):
    for body in ("a" * 10, "é" * 6, "x" + "€" * 4, "ab" + "😀" * 3):
        got = one(spark, text.truncate_bytes(F.lit(body), 8))
        assert len(got.encode()) <= 8 and body.startswith(got)
        assert got == body or len((got + body[len(got)]).encode()) > 8


def test_ellipsis(spark):
    assert one(spark, text.truncate_ellipsis(F.lit("abcdef"), 6)) == "abcdef"
    assert one(spark, text.truncate_ellipsis(F.lit("abcdefg"), 6)) == "abc…"


def test_snippet(spark):
    body = "// File: a\nimport x\n\n// Context: class A\n" + "\n".join(f"l{i}" for i in range(20)) + "\n"
    assert one(spark, text.snippet(F.lit(body))) == "\n".join(f"l{i}" for i in range(12))
    assert one(spark, text.snippet(F.lit(body), full=True)).startswith("l0\n")


@pytest.mark.parametrize(
    "path, kind",
    [("src/a.rs", "implementation"), ("vendor/test_x.py", "generated"), ("tests/a.rs", "test"), ("a_test.go", "test"), ("docs/x.rs", "documentation"), ("README", "documentation"), ("src/FooTest.java", "test"), ("a.min.js", "generated"), ("Cargo.lock", "generated")],
)
def test_classes(spark, path, kind):
    assert one(spark, paths.classify(F.lit(path))) == kind


@pytest.mark.parametrize(
    "glob, path, hit",
    [("*.rs", "src/a.rs", True), ("src/*.rs", "src/a/b.rs", True), ("**/a.rs", "a.rs", True), ("**/a.rs", "x/y/a.rs", True), ("x/**", "x/y", True), ("x/**", "a/x/y", False), ("{a,b}.c", "b.c", True), ("[!a].c", "a.c", False), ("?.c", "b.c", True), ("!a.c", "a.c", False)],
)
def test_globs(spark, glob, path, hit):
    assert one(spark, paths.glob_filter(F.lit(path), [glob])) is hit


def test_invalid_globs_filter_nothing(spark):
    assert paths.globs_regex(["[x", "{a"]) is None
    assert one(spark, paths.glob_filter(F.lit("a"), ["[x"])) is True


def test_metadata_filters(spark):
    f = lambda *x: one(spark, paths.metadata_filter(list(x), F.lit("Src/A.rs"), F.lit("Rust")))
    assert f("lang=rust", "path=src/a") and f("type=x", "loose") and not f("lang=go") and not f("file=b=c")


def test_ingestible(spark):
    kept = lambda p, n=1: one(spark, paths.ingestible(F.lit(p), F.lit(n)))
    assert kept("a.py") and kept("a/data/x.py") and not kept("data/x.py") and not kept("a.png") and kept("a.PNG") and not kept("x.MIN")
    assert not kept("a.py", 5 * 1024 * 1024 + 1) and not kept("yarn.lock") and kept("sub/yarn.lock") and not kept("a/b.log")


def test_cosine(spark):
    c = lambda a, b: one(spark, vectors.cosine(vectors.literal(a), vectors.literal(b)))
    assert c([1, 2], [2, 4]) == pytest.approx(1) and c([1, 0], [0, 1]) == 0 and c([1, 0], [-1, 0]) == -1 and c([0, 0], [1, 0]) == 0


def test_quantise_and_hamming(spark):
    assert one(spark, vectors.quantise(vectors.literal([1, -1, 0, 2]))) == [9]
    long = [1.0 if i % 2 == 0 else -1.0 for i in range(128)]
    words = one(spark, vectors.quantise(vectors.literal(long)))
    assert len(words) == 2 and words[0] == words[1]
    assert one(spark, vectors.hamming(vectors.quantise(vectors.literal(long)), vectors.quantise(vectors.literal([-x for x in long])))) == 128
    assert one(spark, vectors.quantise(vectors.literal([]))) == []
