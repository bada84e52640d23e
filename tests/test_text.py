import random
import re
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelode.config import RunConfig, core_set_size, published_grids, to_bool, to_number
from tracelode.functions import text

BGL = "- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.363779 R02-M1-N0-C:J12-U11 RAS KERNEL INFO cache parity error at 0x00544eb8 from 10.1.2.3:40 /bgl/apps/x"
TBIRD = "- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond(pam_unix)[2915]: session closed for user root from 10.1.2.3 in /var/log/msgs by bob@host-1"
HDFS = "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-1608999687919862906 src: /10.250.19.102:54106 dest: /10.250.19.102:50010 size 67108864"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "value string").select(expression(F.col("value"))).first()[0]


@pytest.mark.parametrize(
    ("kind", "line", "full"),
    [
        ("bgl", BGL, "iar num time server time server ras kernel info cache parity error at memory from ip path"),
        ("tbird", TBIRD, "iar date id date time account crond pam unix num session closed for user root from ip in dir by account"),
        ("hdfs", HDFS, "num num num info dfs datanode dataxceiver receiving block blk src ip dest ip size num"),
    ],
)
def test_masked_lines(spark, kind, line, full):
    assert one(spark, line, lambda c: text.normalize(text.mask(c, kind))) == full


def test_sentences_lose_their_first_fields(spark):
    assert one(spark, BGL, lambda c: text.sentence(c, "bgl", True)) == "server time server ras kernel info cache parity error at memory from ip path"
    assert one(spark, BGL.replace("- ", "KERNDTLB ", 1), lambda c: text.sentence(c, "BGL", True)) == one(spark, BGL, lambda c: text.sentence(c, "bgl", True))
    assert one(spark, TBIRD, lambda c: text.sentence(c, "thunderbird", True)).startswith("date time account crond")


def test_times_and_blocks(spark):
    assert str(one(spark, BGL, text.bgl_timestamp)) == "2005-06-03 15:42:50.363779"
    assert str(one(spark, TBIRD, text.tbird_timestamp)) == "2005-11-09 12:01:01"
    assert one(spark, HDFS, text.first_block) == "blk_-1608999687919862906"
    assert one(spark, "nothing", text.bgl_timestamp) is None
    assert one(spark, "block blk_5 only", text.first_block) is None
    assert one(spark, None, lambda c: text.sentence(c, "bgl", False)) is None


def test_edges(spark):
    assert one(spark, "x /y", lambda c: text.mask(c, "bgl")) == "x /y"
    assert one(spark, "deadbeef", lambda c: text.mask(c, "bgl")) == " IAR "
    assert one(spark, "a b", lambda c: text.drop_fields(c, 3)) == ""
    assert one(spark, "Été ÎLE <*> İx", text.normalize) == "ete ile < > ix"
    assert one(spark, "", lambda c: text.inline_label(c)) is None
    assert spark.createDataFrame([(bytearray(b"ab\xff\xfecd"),)], "b binary").select(text.without_invalid_utf8(F.col("b").cast("string"))).first()[0] == "abcd"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)), min_size=1, max_size=40))
def test_normal_form(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "value string").select("value", text.normalize(F.col("value")).alias("n"), text.normalize(text.normalize(F.col("value"))).alias("nn")).collect()
    for row in got:
        folded = "".join(c for c in unicodedata.normalize("NFD", row["value"].lower()) if unicodedata.category(c) != "Mn")
        want = " ".join("".join(c if c in "<>" or (c.isascii() and c.isalpha()) else " " for c in folded).split())
        assert row["n"] == want == row["nn"]


def test_arguments():
    assert [core_set_size(c, 250) for c in (0, 0.001, 0.01, 1, 10, 999)] == [0, 1, 2, 1, 10, 250]
    with pytest.raises(ValueError):
        core_set_size(-1, 5)
    assert to_bool("Yes") and not to_bool("0") and to_number("10") == 10 and to_number("0.5") == 0.5
    with pytest.raises(ValueError):
        to_bool("maybe")
    runs = published_grids()
    assert sum(map(len, runs.values())) == 357
    assert len({(r.dataset, r.encoder, r.train_ratio, r.core_set, r.only_cls) for g in runs.values() for r in g}) == 261
    with pytest.raises(ValueError):
        RunConfig(train_ratio=0)
    assert RunConfig(sample=5).layout("/r").endswith("bgl_sample_5/0.2/hash/results")


def plain_mask(line, kind):
    """The rules by Python's own expressions, with look-aheads as they are written."""
    for pattern, name in text.RULES[kind]:
        line = re.sub(pattern, name, line)
    return line


@pytest.mark.parametrize("kind", ["bgl", "tbird", "hdfs"])
def test_masks_against_the_plain_rules(spark, kind):
    """Lines with and without a later digit or letter, with all kinds of white space, and of several lines in one."""
    rng = random.Random(7)
    bits = ["R02-M1", "a:b", ":", "-", "--", "x-", "-y", "1", "9z", "zz", "/x/y", "/bgl/apps/1", "10.1.2.3:40", "2005-06-03-15.42.50.675872", "2005.06.03 ", "May 9 ", "Sept 3 ", "Sep 3 ", "June 12 ", "DATE", "12:01:01", "bob@host-1", "bob@host"]
    bits += ["0x00544eb8", "ABCDEFGH" * 4, "deadbeef00", "[291]", "blk_-160899", "blk_5", "é:é1", "ñ-", "TIME", "1117838570"]
    gaps = [" ", " ", " ", "  ", "\t", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "", "\n"]
    lines = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(12))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(lines)), "i long, value string").select("i", text.mask(F.col("value"), kind).alias("m")).collect()
    wrong = [(lines[r.i], r.m, plain_mask(lines[r.i], kind)) for r in got if r.m != plain_mask(lines[r.i], kind)]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("kind", ["bgl", "tbird", "hdfs"])
def test_masks_of_dense_marks(spark, kind):
    """Marks close together, at the ends of words and lines, and between characters of other scripts."""
    rng = random.Random(11)
    lines = ["".join(rng.choice("a1.-:/@_\u00e9\u0661 \t\n\r\x1f\u2003\U0001d7d8") for _ in range(rng.randrange(40))) for _ in range(6000)]
    lines += [f"DATE {x}DATE May 9 Mayday 10 12:01:01 {x}" for x in lines[:500]]
    got = spark.createDataFrame(list(enumerate(lines)), "i long, value string").select("i", text.mask(F.col("value"), kind).alias("m")).collect()
    wrong = [(lines[r.i], r.m, plain_mask(lines[r.i], kind)) for r in got if r.m != plain_mask(lines[r.i], kind)]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("kind", ["bgl", "tbird"])
def test_masks_read_long_lines_once(spark, kind):
    """Words of 40,000 characters, many words with a mark and no digit after them: nothing is read again at every step, and no stack grows with the line."""
    lines = ["9 z" + "a" * 40_000, "a" * 40_000 + "/", "/" * 40_000, "a." * 20_000, "a: b- " * 10_000, "x y " * 20_000 + "a:1z", "@a" * 20_000]
    began = time.time()
    got = [r.m for r in spark.createDataFrame(list(enumerate(lines)), "i long, value string").orderBy("i").select(text.mask(F.col("value"), kind).alias("m")).collect()]
    assert time.time() - began < 20 and len(got) == len(lines)
    if kind == "bgl":
        assert got[4] == lines[4] and got[5] == "x y " * 20_000 + " SERVER "


def test_category_and_label_of_a_masked_line(spark):
    lines = ["- a", "-- a", "-\u2003a", " - a", "KERN a", "\x1f K\x85a", "-", "", " ", "-a"]
    got = spark.createDataFrame(list(enumerate(lines)), "i long, value string").orderBy("i").select(text.category_off(F.col("value")).alias("rest"), text.inline_label(F.col("value")).alias("label")).collect()
    assert [r.rest for r in got] == ["- a", " a", "-\u2003a", " - a", " a", "\x85a", "-", "", " ", ""]
    assert [r.label for r in got] == [0, 1, 0, 0, 1, 1, 0, None, None, 1]


def test_lines_without_a_rule_s_mark_are_not_searched(spark):
    line = F.col("value")
    assert text.mask(line, "bgl")._jc.toString().count("transform") == len(text._NEEDED)
    lines = [(x,) for x in ("a b c", "x/y z", "0x1f g 0Xff", "a-1b", "a:b1", None, "", "\u00e9-1 \u00e9/a", "-", ":", "/")]
    plain = spark.createDataFrame(lines, "value string")
    changed = line
    for rule in text.RULES["bgl"]:
        pattern, name = text._ONCE.get(rule[0], rule)
        changed = F.regexp_replace(changed, text._meant(pattern), name)
    assert plain.where(~text.mask(line, "bgl").eqNullSafe(changed)).count() == 0
    folded = F.trim(F.regexp_replace(F.translate(F.lower(line), *text.fold_table()), "[^a-z<>]+", " "))
    assert plain.where(~text.normalize(line).eqNullSafe(folded)).count() == 0
