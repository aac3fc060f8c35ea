"""Paths of reports, one shape after another."""

import pytest

from codeperil.sources.paths import resolved_paths


@pytest.mark.parametrize("roots", [["/w/repo/src"], ["/other", "/w/repo/src/"], ["src"], []])
def test_paths(spark, roots):
    files = ["main.rs", "deep/a.rs", "b/a.rs", "a.rs", "crates/x/src/lib.rs", "lib.rs"]
    cases = [
        ("/w/repo/src/main.rs", "main.rs", "lexical" if "/w/repo/src" in roots[-1:] or "/w/repo/src/" in roots else "suffix"),
        ("deep/a.rs", "deep/a.rs", "lexical"),
        ("./deep//a.rs", "deep/a.rs", "lexical"),
        ("/ci/build/b/a.rs", "b/a.rs", "suffix"),
        ("/ci/build/c/a.rs", "a.rs", "suffix"),  # the longest end that is a file
        ("x\\deep\\a.rs", "deep/a.rs", "suffix"),
        ("/w/repo/src/../deep/a.rs", "deep/a.rs", "suffix"),
        ("../../main.rs", "main.rs", "suffix"),
        ("deep/a.rs/..", "deep/a.rs/..", "fallback"),
        ("/nowhere/none.rs", "/nowhere/none.rs", "fallback"),
        ("/w/repo/srcs/none.rs", "/w/repo/srcs/none.rs", "fallback"),
        ("none.rs", "none.rs", "fallback"),
        ("/w/repo/src/gone/none.rs", "gone/none.rs" if roots and roots[-1].startswith("/w") else "/w/repo/src/gone/none.rs", "fallback"),
        ("src/crates/x/src/lib.rs", "crates/x/src/lib.rs", "lexical" if roots == ["src"] else "suffix"),
        ("", "", "fallback"),
    ]
    sources = spark.createDataFrame([*((c[0],) for c in cases), (None,), ("none.rs",)], "source string")
    got = resolved_paths(sources, spark.createDataFrame([*((f,) for f in files), ("main.rs",), ("",), (None,)], "file_path string"), roots)
    assert sorted(map(tuple, got.collect())) == sorted(cases)
    assert resolved_paths(sources.where("false"), sources.selectExpr("source AS file_path"), roots).count() == 0
