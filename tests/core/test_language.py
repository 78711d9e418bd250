import pytest

from docspark.plans import conditions
from docspark.plans.compiler import compile_query, like_regex
from docspark.plans.errors import QueryError
from docspark.plans.parser import parse, tokens


def reason(text, params=None):
    with pytest.raises(QueryError) as e:
        compile_query(text, params)
    return e.value


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("SELECT * FROM d WHERE a = NULL", "use_is_null"),
        ("SELECT * FROM d WHERE a IN (1, NULL)", "use_is_null"),
        ("SELECT * FROM d WHERE 1 = 2", "constant_predicate"),
        ("SELECT * FROM d WHERE a = b", "unsupported:path_comparison"),
        ("SELECT * FROM d WHERE a BETWEEN b AND 3", "unsupported:path_between_bound"),
        ("SELECT * FROM d WHERE d = 3", "unsupported:bare_source_reference"),
        ("SELECT * FROM d WHERE a[*] = 3", "unsupported:wildcard_path"),
        ("SELECT * FROM d WHERE _rev = 3", "reserved_field"),
        ("SELECT _score FROM d", "reserved_field"),
        ("SELECT _distance FROM bm25_top_k('x') AS h", "reserved_field"),
        ("SELECT * FROM vector_top_k('x') AS h WHERE _score > 0.5", "unsupported:score_in_where"),
        ("SELECT * FROM vector_top_k('x')", "alias_required"),
        ("SELECT * FROM nope('x') AS h", "unknown_table_function"),
        ("SELECT * FROM bm25_top_k(3) AS h", "invalid_table_fn_arg"),
        ("SELECT * FROM bm25_top_k('x', k => 0) AS h", "invalid_table_fn_arg"),
        ("SELECT * FROM bm25_top_k('x', ef_search => 5) AS h", "invalid_table_fn_arg"),
        ("SELECT * FROM bm25_top_k('x', k => 1, k => 2) AS h", "invalid_table_fn_arg"),
        ("SELECT * FROM bm25_top_k('x', z => 2) AS h", "invalid_table_fn_arg"),
        ("SELECT * FROM bm25_top_k('x', 'y') AS h", "invalid_table_fn_arg"),
        ("SELECT * FROM d WHERE id = 3", "unsupported:id_condition"),
        ("SELECT * FROM d WHERE id != 'x'", "unsupported:id_condition"),
        ("SELECT * FROM d WHERE id LIKE '%x'", "unsupported:id_condition"),
        ("SELECT * FROM d WHERE id = 'x' OR a = 1", "unsupported:id_in_disjunction"),
        ("SELECT * FROM d ORDER BY a, b", "unsupported:multi_key_order_by"),
        ("SELECT * FROM d ORDER BY d", "invalid_order_key"),
        ("SELECT a, x.a FROM d", "duplicate_output_name"),
        ("SELECT a[0] FROM d", "alias_required"),
        ("SELECT * FROM d, UNNEST(d) AS t", "invalid_unnest_path"),
        ("SELECT * FROM d, UNNEST(t.x) AS t", "invalid_unnest_path"),
        ("SELECT * FROM d AS t, UNNEST(x.y) AS t", "duplicate_alias"),
        ("SELECT * FROM d ORDER BY a SUBSCRIBE", "unsupported_with_subscribe"),
        ("SELECT * FROM d OFFSET 3 SUBSCRIBE", "unsupported_with_subscribe"),
        ("SELECT * FROM d, UNNEST(d.x) AS t SUBSCRIBE", "unsupported_with_subscribe"),
        ("SELECT * FROM d WHERE a = $x", "unbound_param"),
        ("SELECT * FROM d WHERE d.active", "syntax"),
        ("SELECT * FROM d JOIN e", "syntax"),
        ("SELECT count(a) FROM d", "syntax"),
        ("SELECT * FROM d GROUP BY a", "syntax"),
        ("SELECT * FROM d LIMIT $n", "syntax"),
        ("SELECT * FROM d WHERE a IN ($x)", "syntax"),
        ("SELECT * FROM d WHERE a = #", "syntax"),
    ],
)
def test_rejected(text, code):
    assert reason(text).reason == code


def test_error_text_has_place():
    assert str(reason("SELECT *\nFROM d\nWHERE  a = NULL")).startswith("line 3 column 10: nothing equals NULL")
    assert reason("SELECT * FROM d WHERE a = $x", {"x": [1]}).reason == "invalid_param"


def test_tokens():
    kinds = [(k, v) for k, v, _ in tokens("select \"a\"\"b\" 'it''s' 1.5 -- gone\n $p <>")]
    assert kinds == [("kw", "SELECT"), ("ident", 'a"b'), ("str", "it's"), ("float", 1.5), ("param", "p"), ("op", "<>"), ("end", None)]


def test_keywords_after_dot():
    assert parse("SELECT d.order.BY FROM d").select[0].path.keys == ("d", "order", "by")


def test_not_is_dualized():
    where = compile_query("SELECT * FROM d WHERE NOT (a = 1 AND (b < 2 OR c IN (3)))").where
    assert where == [("or", [("compare", ["a"], "=/=", 1), ("and", [("compare", ["b"], ">=", 2), ("and", [("exists", ["c"]), ("not", ("in", ["c"], [3]))])])])]


def test_flip_and_between():
    assert compile_query("SELECT * FROM d WHERE 3 < a").where == [("compare", ["a"], ">", 3)]
    assert compile_query("SELECT * FROM d WHERE a NOT BETWEEN 1 AND 2").where == [("or", [("compare", ["a"], "<", 1), ("compare", ["a"], ">", 2)])]
    assert len(compile_query("SELECT * FROM d WHERE a BETWEEN 1 AND 2 AND b = 1").where) == 3


def test_precedence():
    assert compile_query("SELECT * FROM d WHERE a = 1 OR b = 2 AND c = 3").where == [("or", [("path", ["a"], 1), ("and", [("path", ["b"], 2), ("path", ["c"], 3)])])]


def test_id_ranges_merge():
    assert compile_query("SELECT * FROM d WHERE id >= 'b' AND id < 'k' AND id LIKE 'c%'").id_range == ("c", "c\U0010ffff")
    assert compile_query("SELECT * FROM d WHERE id > 'b' AND id <= 'b'").empty
    assert compile_query("SELECT * FROM d WHERE id = 'b'").id_range == ("b", "b\0")
    assert compile_query("SELECT * FROM d LIMIT 0").empty


def test_like_regex():
    assert like_regex("a.b%_") == r"^a\.b.*.$"


def test_wire_codec_round_trip():
    c = conditions.normalize(["and", [["path", ["a", 0], "?X"], ["not", ["in", ["b"], [1, "x", None]]], ["compare", ["c"], ">", "?X"]]])
    assert conditions.from_json(conditions.to_json(c)) == c


@pytest.mark.parametrize("bad", [["path"], ["nope", ["a"], 1], ["compare", ["a"], "~", 1], ["regex", ["a"], 3], ["path", ["*"], 1], ["path", [], 1], []])
def test_invalid_conditions(bad):
    with pytest.raises(QueryError):
        conditions.normalize(bad)


def test_bindings_of_disjunction():
    cs = [conditions.normalize(["or", [[["path", ["a"], "?X"], ["path", ["b"], "?Y"]][0], ["path", ["a"], "?X"]]])]
    assert conditions.bindings(cs) == {"?X": ["a"]}
