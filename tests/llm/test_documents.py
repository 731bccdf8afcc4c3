"""Packing, mixing and personal information."""

import os
import random
import re
from collections import Counter, defaultdict
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnwork.llm import mixing as M
from kilnwork.llm import packing as K
from kilnwork.llm import personal as P
from kilnwork.llm import pseudonyms as Y
from kilnwork.llm.tokens import public_vocabulary, token_sizes

pytest.importorskip("public_tokenizers")


def test_token_sizes(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["", "Hello world", "a" * 30_000, "<|endoftext|> é ★\n\n", "x y  z"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in token_sizes(df, ["id"], "text").collect()}
    assert got == {i: len(other.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert public_vocabulary()[0].endswith("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("containers", [2, 1000])
def test_pack_places_every_token_once(spark, containers):
    draw = random.Random(1)
    sizes = [(i, min(int(draw.paretovariate(0.8) * 20), 5000)) for i in range(1500)] + [(2000, 0), (2001, 100), (2002, 101), (2003, 250), (2004, None), (None, 5), (2005, -1)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "id long, n int, container string")
    rows = K.pack(df, "id", "n", 100, containers).collect()
    by, room = defaultdict(list), Counter()
    for r in rows:
        by[r["id"]].append((r["piece"], r["start"], r["n_tokens"]))
        room[r["container"]] += r["n_tokens"]
    assert max(room.values()) <= 100
    for i, n in sizes:
        if i is None or n is None or n < 0:
            assert i is None or i not in by
            continue
        pieces = sorted(by[i])
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(x for _, _, x in pieces) == n
        assert len(pieces) == max(1, -(-n // 100))  # cut only if larger than the capacity
        assert all(s == p * 100 for p, s, _ in pieces)
    total = sum(room.values())
    if containers == 1000:
        assert len(room) <= 1.02 * total / 100 + 2


def test_pack_edges(spark):
    empty = spark.createDataFrame([], "id long, n int")
    assert K.pack(empty, "id", "n", 10).collect() == []
    zeros = spark.createDataFrame([(i, 0) for i in range(5)], "id long, n int")
    assert len({r["container"] for r in K.pack(zeros, "id", "n", 10).collect()}) == 1
    repeated = spark.createDataFrame([(1, 6), (1, 6)], "id long, n int")
    assert len({r["container"] for r in K.pack(repeated, "id", "n", 10).collect()}) == 2
    with pytest.raises(ValueError):
        K.pack(empty, "id", "n", 0)


def test_packing_a_million_items_in_bounded_partitions(spark):
    from pyspark.sql import functions as F

    sizes = spark.range(1_000_000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(997)) + 3).alias("n"))
    packed = K.pack(sizes, "id", "n", 2048, 128)
    assert packed.rdd.getNumPartitions() <= 4 * K.TASKS_A_CORE  # some 1,900 shards
    row = K.invariants(packed, sizes, "id", "n", 2048, 0.02).first()
    assert row["items"] == 1_000_000 and tuple(row)[2:] == (0, 0, 0, 0, 0)


def test_runs_are_placed_like_single_items():
    draw = random.Random(5)
    one, many = K.SumOfSquares(60), K.SumOfSquares(60)
    for _ in range(200):
        size, times = draw.randint(0, 60), draw.randint(1, 9)
        assert many.place_run(size, times) == [one.place(size) for _ in range(times)]


def test_sum_of_squares_takes_the_place_of_least_squares():
    draw, s = random.Random(3), K.SumOfSquares(20)
    gaps = []  # brute force: the gap of each container
    for _ in range(400):
        size = draw.randint(1, 20)
        square = lambda g: sum(c * c for k, c in Counter(g).items() if 0 < k < 20)
        options = [[*gaps, 20 - size], *[[*gaps[:i], g - size, *gaps[i + 1 :]] for i, g in enumerate(gaps) if g >= size]]
        at = s.place(size)
        gaps = [*gaps, 20 - size] if at == len(gaps) else [g - size if i == at else g for i, g in enumerate(gaps)]
        assert square(gaps) == min(map(square, options)) and min(gaps) >= 0


MIX = [("Big ", 0.5, 1), ("small", 0.3, 4), ("none", 0.1, 3), ("tiny", 0.1, 2), ("free", None, 2)]


@pytest.fixture
def mixed(spark):
    draw = random.Random(2)
    docs = [(i, "big" if i % 4 else " SMALL", draw.randint(5, 60)) for i in range(3000)] + [(5000 + i, "Tiny", 40) for i in range(60)] + [(9000, None, 5), (9001, "unlisted", 5)]
    sizes = spark.createDataFrame(docs, "doc long, source string, n_tokens long")
    sizes = sizes.withColumn("source", M.source_name(sizes["source"]))
    return docs, sizes, spark.createDataFrame(MIX, "source string, target_share double, max_repeats int")


def test_mix_reaches_targets_within_caps(spark, mixed):
    docs, sizes, mix = mixed
    rate = M.rates(sizes, mix)
    got = {r["source"]: r for r in M.shares(sizes, "doc", rate).collect()}
    # what has documents keeps its proportions; the source without any can't be met
    for s, share in (("big", 0.5), ("small", 0.3), ("tiny", 0.1)):
        assert got[s]["reached_share"] == pytest.approx(share / 0.9, abs=0.03)
    assert got["none"]["capped"] and got["none"]["reached_share"] == 0 and got["none"]["emitted"] == 0
    assert not got["free"]["capped"] and got["free"]["emitted"] == 0
    copies = M.mixed(spark.createDataFrame([(d, s, "text") for d, s, _ in docs], "doc long, source string, text string"), "doc", "source", rate, ["text"]).collect()
    count = Counter(r["doc"] for r in copies)
    cap = {"big": 1, "small": 4, "tiny": 2}
    assert all(count[d] <= cap.get((s or "").strip().lower(), 0) for d, s, _ in docs)
    assert sum(got[s]["emitted"] for s in got) == len(copies)
    for d, s, _ in docs:  # floor(rate) or one more
        r = got.get((s or "").strip().lower())
        assert count[d] == 0 if r is None else int(r["rate"]) <= count[d] <= int(r["rate"]) + 1


def test_mix_with_a_total_out_of_reach(spark, mixed):
    _, sizes, mix = mixed
    got = {r["source"]: r for r in M.rates(sizes, mix, total=1e9).collect()}
    assert all(got[s]["capped"] and got[s]["rate"] == got[s]["max_repeats"] for s in ("big", "small", "tiny"))


def test_mix_of_nothing(spark, mixed):
    _, sizes, mix = mixed
    assert all(r["rate"] == 0 for r in M.rates(sizes.limit(0), mix).collect())
    assert M.rates(sizes, mix.limit(0)).collect() == []


GIVEN = ["Nora", "Tom", "Maria", "Rose", "May", "Will", "Grace", "Otto"]
FINDER = P.Finder(GIVEN)


def found(text):
    return [(text[a:b], k) for a, b, k in FINDER.find(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to nora.smith+eats@post.test, please", [("nora.smith+eats@post.test", "email")]),
        ("at xy12 [at] my-table [dot] test.", [("xy12 [at] my-table [dot] test", "email")]),
        ("mail omar at mail dot example now", [("omar at mail dot example", "email")]),
        ("a(at)example.com;B.C＠EXAMPLE.ORG", [("a(at)example.com", "email"), ("B.C＠EXAMPLE.ORG", "email")]),
        ("Write to info@ or use the form. Follow @nora_eats, seven @ $19 each", []),
        ("call (523)555-0188, +1 944 555 0133 or 743–555–0185", [("(523)555-0188", "phone"), ("+1 944 555 0133", "phone"), ("743–555–0185", "phone")]),
        ("Llame al (+34) 910005795 o 91-000-34-41", [("(+34) 910005795", "phone"), ("91-000-34-41", "phone")]),
        ("0033 (0)1 99 00 29 90 et 01.99.00.47.88", [("0033 (0)1 99 00 29 90", "phone"), ("01.99.00.47.88", "phone")]),
        ("Rufen Sie +49 (0)30 23125-486 an, 030/23125116", [("+49 (0)30 23125-486", "phone"), ("030/23125116", "phone")]),
        ("020 7946 0735 (01632) 960 780", [("020 7946 0735", "phone"), ("(01632) 960 780", "phone")]),
        ("Order #568-50-5132, Lot 930-33/1094, Batch 2031-04-1187, Barcode 0000123400056, INV896840759", []),
        ("SSN 978-77-6994 and 916.91.2835 and tax 953901194", [("978-77-6994", "identity"), ("916.91.2835", "identity"), ("953901194", "identity")]),
        ("DNI 00.004.488-Q, NIE X-0015060-U, L00 X07536 Q, 00/614/69130", [("00.004.488-Q", "identity"), ("X-0015060-U", "identity"), ("L00 X07536 Q", "identity"), ("00/614/69130", "identity")]),
        ("0 99 13 99 929 449 30; QQ 76 33 54 Z; XQ0503347; Q928-5714-8800", [("0 99 13 99 929 449 30", "identity"), ("QQ 76 33 54 Z", "identity"), ("XQ0503347", "identity"), ("Q928-5714-8800", "identity")]),
        ("I live at Flat 23, 13 Dovemil Blvd, Hidun so", [("Flat 23, 13 Dovemil Blvd, Hidun", "address")]),
        ("to 1303 N. Plinel Road, Unit 43, Foo Bay, QX 00911.", [("1303 N. Plinel Road, Unit 43, Foo Bay, QX 00911", "address")]),
        ("near 5th Avenue, the 400 block, 3 streets away, $84 each near Gretusos Road", []),
        ("Vivo en C/ Staitrea, 96, 3.º B, muy cerca", [("C/ Staitrea, 96, 3.º B", "address")]),
        ("J'habite 70 bis, avenue Tudistir, 00350 Rostat Falls, tout", [("70 bis, avenue Tudistir, 00350 Rostat Falls", "address")]),
        ("Lieferung nach Briferweg 20a, 00697 Veadea, Ausweis", [("Briferweg 20a, 00697 Veadea", "address")]),
        ("Our server Jonas Chumufeal was wonderful.", [("Jonas Chumufeal", "name")]),
        ("Dr. O. McKlumokler left an umbrella", [("O. McKlumokler", "name")]),
        ("ask for Gobin, Sofia.", [("Gobin, Sofia", "name")]),
        ("Regards,\nKarim van Poulos\n12 Foo Lane", [("Karim van Poulos", "name"), ("12 Foo Lane", "address")]),
        ("Maria biscuits and Rose tea. May brought a crowd. Will the soup return? Thank you for visiting Nora's Diner.", []),
        ("My name is not important here. Dear guest, Ask for the manager on duty. Regards,\nthe whole team", []),
        ("Reservation under tom nelson for six, cell 555-0145", [("tom nelson", "name"), ("555-0145", "phone")]),
        ("", []),
    ],
)
def test_finds(text, want):
    assert found(text) == want


def test_finds_in_very_long_text():
    text = "soup " * 100_000 + "call 523-555-0188"
    assert FINDER.find(text) == [(500_005, 500_017, "phone")]
    assert FINDER.find("9" * 20_000 + " " + "a" * 20_000) == []


def test_redaction_links_equal_values(spark):
    texts = [(1, "call 523-555-0188"), (2, "txt (523) 555 0188, Otto Fisch called from 523.555.0188"), (3, None), (4, ""), (4, ""), (5, "nothing ★ here")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "id int, text string, found string")
    names = spark.createDataFrame([("Otto", "given"), (None, "family")], "name string, name_kind string")
    got = P.personal(df, ["id"], "text", names, b"k").collect()
    by = {r["id"]: r for r in got}
    digits = {re.sub(r"\D", "", m) for r in got if r["redacted"] for m in re.findall(r"<phone:([^>]*)>", r["redacted"])}
    assert len(digits) == 1 and digits != {"5235550188"} and len(got) == 6
    assert by[3]["redacted"] is None and by[4]["redacted"] == "" and by[5]["redacted"] == "nothing ★ here"
    assert [(f["kind"], f["start_pos"]) for f in by[2]["found"]] == [("phone", 4), ("name", 20), ("phone", 43)]


def test_no_names_and_no_rows(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert P.personal(df, ["id"], "text", None, b"k").collect() == []


MARK = re.compile(r"\[(name|email|phone|identity|address|date):([^\]]*)\]")


def marked(path):
    """Texts of a file and what is marked in them: (start, end, kind); a title belongs to no name."""
    with open(os.path.join(os.path.dirname(__file__), path)) as f:
        lines = [line.rstrip("\n").replace("\\n", "\n") for line in f if line.strip() and not line.startswith("#")]
    for line in lines:
        text, want, at = "", set(), 0
        for m in MARK.finditer(line):
            text += line[at : m.start()]
            title = re.match(r"(?:(?:Mr|Mrs|Ms|Dr|Sra|Frau|Madame)\.? )+", m[2]) if m[1] == "name" else None
            shown = m[2][len(title[0]) :] if title else m[2]
            text += title[0] if title else ""
            want.add((len(text), len(text) + len(shown), m[1]))
            text, at = text + shown, m.end()
        yield text + line[at:], want


@pytest.mark.parametrize("path", ["personal_sentences.txt", "personal_held_out.txt"])
def test_sentences_apart_from_the_tables(path):
    finder, right, wrong, missed = P.Finder(), 0, 0, 0
    for text, want in marked(path):
        got = set(finder.find(text))
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.9


SENTENCES = [t for t, _ in [*marked("personal_sentences.txt"), *marked("personal_held_out.txt")]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SENTENCES), min_size=1, max_size=4), st.integers(0, 500), st.sampled_from(["soup ", "\t", "\n", "é. "]))
def test_finds_do_not_depend_on_the_place_in_the_text(parts, times, filler):
    pad = f"\n{filler * times}\n"
    text, want = "", []
    for p in parts:
        want += [(a + len(text), b + len(text), k) for a, b, k in FINDER.find(p)]
        text += p + pad
    assert FINDER.find(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789+()-./ xeABtQ\n\xa0", max_size=120))
def test_numbers_in_runs_are_those_of_the_whole_text(text):
    whole = [(0, len(text))]
    windows = P.number_windows(text)
    assert sorted(P.numbers(text, windows)) == sorted(P.numbers(text, whole))
    assert sorted(P.checked_numbers(text, windows)) == sorted(P.checked_numbers(text, whole))


@pytest.mark.parametrize("size", [10, 200, 5000])
def test_values_of_any_length(size):
    mail = "a" * size + "@example.com"
    assert found(f"write to {mail} now") == [(mail, "email")]
    name = "Wolfeschlegel" + "a" * size
    assert found(f"Please ask for{' ' * size}Siobhan {name}.") == [(f"Siobhan {name}", "name")]
    assert found(f"12 {'M' + 'a' * size} Street") == [(f"12 {'M' + 'a' * size} Street", "address")]


@pytest.mark.parametrize("card", ["4111 1111 1111 1111", "4111-1111-1111-1111", "5555555555554444", "378282246310005", "6011.1111.1111.1117", "4222222222222"])
def test_cards_in_all_spellings(card):
    assert found(f"I paid with {card}, twice") == [(card, "identity")]
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    assert (wrong, "identity") not in found(f"I paid with {wrong}, twice")


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-. ", max_size=24), st.binary(min_size=1, max_size=16))
def test_feistel_permutes_within_the_format(value, key):
    out = Y.feistel(value, key)
    shape = lambda v: re.sub("[0-9]", "9", re.sub("[A-Z]", "A", v))
    assert shape(out) == shape(value) and Y.feistel(out, key, back=True) == value


def test_feistel_is_one_to_one():
    assert len({Y.feistel(f"{i:03d}", b"k") for i in range(1000)}) == 1000


@settings(max_examples=200, deadline=None)
@given(st.text("0123456789", min_size=14, max_size=14), st.binary(min_size=1, max_size=16), st.integers(0, 9))
def test_cards_keep_the_distance_of_their_check_digit(body, key, apart):
    body = "4" + body
    check = (Y.luhn_digit(body) + apart) % 10
    new = Y.identity(body + str(check), key)
    assert new[0] == "4" and (int(new[-1]) - Y.luhn_digit(new[:-1])) % 10 == apart


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 99_999_999), st.integers(0, 22), st.binary(min_size=1, max_size=16))
def test_identity_letters_keep_their_distance(number, apart, key):
    value = f"{number:08d}" + Y.DNI_LETTERS[(number + apart) % 23]
    new = Y.identity(value, key)
    assert (Y.DNI_LETTERS.index(new[-1]) - int(new[:-1])) % 23 == apart


def test_checked_formats_stay_valid_and_one_to_one():
    ibans = {f"DE{98 - Y._as_number(f'{i:018d}DE00') % 97:02d}{i:018d}" for i in range(500)}
    new = {Y.identity(v, b"k") for v in ibans}
    assert len(new) == 500 and all(map(Y.iban_valid, ibans | new)) and new != ibans
    odd = {f"DE{c:02d}{7:018d}" for c in range(100)}
    assert len({Y.identity(v, b"k") for v in odd}) == 100
    nir = [f"1{i:012d}{-int(f'1{i:012d}') % 97 or 97:02d}" for i in range(500)]
    new = {Y.identity(v, b"k") for v in nir}
    assert len(new) == 500 and all(-int(v[:13]) % 97 == int(v[13:]) % 97 for v in new)


@settings(max_examples=300, deadline=None)
@given(st.dates(Y._FIRST, date(2099, 12, 31)), st.binary(min_size=1, max_size=16))
def test_days_are_permuted(day, key):
    assert Y.moved(Y.moved(day, key), key, back=True) == day


def test_dates_stay_dates_and_are_linked():
    new = [Y.date_like(v, b"k") for v in ("23.08.1964", "1964-08-23", "23 August 1964", "August 23, 1964", "8/23/1964", "23 de agosto de 1964")]
    days = {Y.date_parts(Y.DATE.fullmatch(v))[0] for v in new}
    assert len(days) == 1 and days != {date(1964, 8, 23)}
    assert Y.date_parts(Y.DATE.fullmatch("31.02.1999")) is None
    assert len({Y.moved(date.fromordinal(Y._FIRST.toordinal() + i), b"k") for i in range(3000)}) == 3000


def test_numbers_are_linked_as_they_should():
    national = lambda v: re.sub(r"\D", "", re.split("ext|x", Y.phone(v, b"k"))[0])[-9:]
    assert national("+44 (0)20 7946 0321") == national("+44 20 7946 0321") == national("0044 20 7946 0321")
    assert len({national(v) for v in ("523-555-0188", "(523) 555 0188", "+1 523.555.0188", "1-523-555-0188", "523-555-0188 ext 5")}) == 1
    a, b, c = (Y.phone(v, b"k") for v in ("523-555-0188 ext 5", "523-555-0188 ext 6", "523-555-0188 x5"))
    assert a != b and a[-1] == c[-1] and a[:12] == b[:12] == c[:12]
    assert Y.phone("+44 (0)20 7946 0321", b"k").startswith("+44 (0)") and len({Y.phone(f"+49 30 {i:05d}", b"k") for i in range(2000)}) == 2000


def test_dates_of_birth_are_redacted(spark):
    df = spark.createDataFrame([(1, "Opened 2019-05-12. I was born on 12/03/1985.")], "id int, text string")
    row = P.personal(df, ["id"], "text", None, b"k").first()
    assert [f["kind"] for f in row["found"]] == ["date"] and "2019-05-12" in row["redacted"] and "12/03/1985" not in row["redacted"]
    assert re.search(r"<date:\d\d/\d\d/\d{4}>", row["redacted"])
    assert len(P.Finder(dates="all").find("Opened 2019-05-12. Born 12/03/1985.")) == 2 and P.Finder(dates=None).find("Born 12/03/1985.") == []
    with pytest.raises(ValueError):
        P.personal(df, ["id"], "text", None, None)
