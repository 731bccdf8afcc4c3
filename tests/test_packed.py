"""Packed fields: delimiter inference and splitting against an independent parser."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kilnwork.operators.packed import infer_delimiters, split_packed

VALUES = ["Pubs", "Soup, Hot", "Coffee & Cake", "Drive-In/Drive-Thru", "Rock 'n' Bowl", "Kids' Wear", '6" Subs', "Paper; Ink", "Drinks | Late", "24/7 Gyms", "Cafés", '"Slow" Kitchens', "Tea-Rooms"]
PLAIN = [v for v in VALUES if not re.search(r'[,;|"]', v)]


def packed(values, hand):
    if hand == "json":
        return json.dumps(values)
    if hand == "csv":
        return ",".join('"' + v.replace('"', '""') + '"' for v in values)
    if hand == "single":
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"
    if hand == "bullet":
        return "• " + " • ".join(values)
    return hand.join(values)


def split(spark, fields, **more):
    df = spark.createDataFrame(list(enumerate(fields)), "id int, packed string")
    return sorted(tuple(r) for r in split_packed(df, "packed", ["id"], **more).collect())


def expect(lists):
    return sorted((i, p, v) for i, values in enumerate(lists) for p, v in enumerate(values))


@pytest.mark.parametrize("hand", [", ", ",", "; ", " | ", "||", "\t", "\r\n", "，", "；", "、", " / ", "bullet"])
def test_plain_hands(spark, hand):
    lists = [PLAIN[i:] + PLAIN[:i] for i in range(len(PLAIN))]
    assert split(spark, [packed(v, hand) for v in lists]) == expect(lists)


@pytest.mark.parametrize("hand", ["json", "csv", "single"])
def test_quoting_hands(spark, hand):
    values = [v for v in VALUES if hand != "single" or '"' not in v]
    lists = [values[i:] + values[:i] for i in range(len(values))]
    assert split(spark, [packed(v, hand) for v in lists]) == expect(lists)


def test_mixed_delimiters_in_one_field(spark):
    known = [packed(PLAIN, ", "), packed(PLAIN, ";")]
    assert split(spark, [*known, "Pubs ,Cafés;Tea-Rooms,\tKids' Wear"])[-4:] == [(2, 0, "Pubs"), (2, 1, "Cafés"), (2, 2, "Tea-Rooms"), (2, 3, "Kids' Wear")]


def test_a_mark_within_values_is_no_delimiter_of_its_source(spark):
    """In the second source commas belong to values, which other fields show as single quoted values."""
    fields = [('a', '"Soup, Hot","Bread, Fresh","Pubs"'), ('b', "Soup, Hot;Bread, Fresh;Pubs"), ('b', "Bread, Fresh;Pubs;Soup, Hot")]
    df = spark.createDataFrame(fields, "src string, packed string")
    got = {r["source"]: r["delimiters"] for r in infer_delimiters(df, "packed", "src").where("source = 'b'").collect()}
    assert got == {"b": "semicolon"}
    assert sorted(r["value"] for r in split_packed(df.where("src = 'b'").unionByName(df.where("src = 'a'")), "packed", ["src"], "src").where("src = 'b'").collect()) == sorted(["Soup, Hot", "Bread, Fresh", "Pubs"] * 2)


def test_nulls_blanks_places_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, " , ,", "x"), (5, ", Pubs, ,Pubs,", "x"), (6, "Pubs", "x"), (6, "Pubs", "x"), (None, "Pubs, Cafés", None)],
        "id int, packed string, value string",
    )
    got = sorted((r[0] or 0, r[1], r[2]) for r in split_packed(df.withColumnRenamed("value", "pos"), "packed", ["id"]).collect())
    assert got == [(0, 0, "Pubs"), (0, 1, "Cafés"), (5, 0, "Pubs"), (5, 1, "Pubs"), (6, 0, "Pubs"), (6, 0, "Pubs")]


def test_empty_table_and_very_long_field(spark):
    empty = spark.createDataFrame([], "id int, packed string")
    assert split_packed(empty, "packed", ["id"]).collect() == []
    long = [["Pubs", "Cafés"] * 20_000]
    assert split(spark, [packed(long[0], ",")]) == expect(long)
    quoted = [["Soup, Hot", '6" Subs'] * 10_000]
    assert split(spark, [packed(quoted[0], "csv")]) == expect(quoted)


def test_quotes_within_a_value_belong_to_it(spark):
    assert split(spark, ['6" Subs, Pubs', '"  Pubs "', "Kids' Wear, 'Soup, Hot'"]) == [(0, 0, '6" Subs'), (0, 1, "Pubs"), (1, 0, "Pubs"), (2, 0, "Kids' Wear"), (2, 1, "Soup, Hot")]


def test_blanks_of_any_number_before_a_quote(spark):
    assert split(spark, ['Bars,         "Food, Fast"', f'{" " * 300}"Soup, Hot";Bars']) == [(0, 0, "Bars"), (0, 1, "Food, Fast"), (1, 0, "Soup, Hot"), (1, 1, "Bars")]


def test_private_characters_of_the_data_stay(spark):
    odd = "\ue000a\ue003b\ue010c\ue001"
    assert split(spark, [f'"{odd}, x",{odd}, Bars', odd]) == [(0, 0, f"{odd}, x"), (0, 1, odd), (0, 2, "Bars"), (1, 0, odd)]


def test_very_long_quoted_value(spark):
    value = 'Soup, "Hot" ' * 20_000 + "end"
    assert split(spark, [packed([value, "Bars"], "json"), packed([value, "Bars"], "csv")]) == expect([[value, "Bars"]] * 2)


def test_counts_decide_between_equally_regular_options(spark):
    """No piece is known beforehand and all are of one type; cut at semicolons, every field has three of them."""
    fields = [f"{a};{b};{c}" for a, b, c in zip(["Ab, Cd", "Ef", "Gh, Ij", "Kl, Mn"] * 5, ["Op", "Qr, St", "Uv, Wx", "Yz"] * 5, ["Aa, Bb", "Cc, Dd", "Ee", "Ff"] * 5)]
    df = spark.createDataFrame([("s", f) for f in fields] + [("t", f'"{x}"') for x in ("Ab, Cd", "Gh, Ij", "Kl, Mn", "Qr, St", "Uv, Wx", "Aa, Bb", "Cc, Dd")], "src string, packed string")
    got = {r["source"]: r for r in infer_delimiters(df, "packed", "src").collect()}
    assert got["s"]["delimiters"] == "semicolon"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from(PLAIN), min_size=1, max_size=6), st.sampled_from([", ", ";", "|", "json", "csv", "\t"])), min_size=1, max_size=12))
def test_round_trip(spark, fields):
    assert split(spark, [packed(v, h) for v, h in fields]) == expect([v for v, _ in fields])
