"""Character references in columns against the standard library."""

import random
from html import entities, unescape

from pyspark.sql import functions as F

from shirabe.functions.entities import unescape as columns


def test_unescape_equals_the_standard_library(spark):
    r = random.Random(5)
    names = sorted(entities.html5)
    cases = [f"a&{n}b" for n in names] + [f"&{n.rstrip(';')}" for n in names[::5]] + [f"&{n.rstrip(';')}x;" for n in names[::7]]
    cases += [f"&#{n};" for n in [*range(0, 300), 0x2028, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**30]]
    cases += [f"&#x{n:x}" for n in (0, 9, 0x80, 0x9F, 0x41, 0x1F600, 0x110000, 1 << 80)] + ["&#X41;&#x00041;&#065", "&", "&&", "&;", "& amp;", "&amp", "&ampamp;", "&ampx", "&notit;", "&notin;", "&#;", "&#x;", "&#xg;", "a & b", "&" + "x" * 40 + ";", "&lt;&lt&gt", "", "日本&copy本"]
    pool = ["&", "amp", ";", "lt", "#", "x41", "65", " ", "not", "in", "あ", "copy", "<", "\n"]
    cases += ["".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(500)]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", columns(F.col("t")).alias("u")).collect()
    wrong = [(cases[x["i"]], x["u"], unescape(cases[x["i"]])) for x in got if x["u"] != unescape(cases[x["i"]])]
    assert not wrong, (len(wrong), wrong[:20])
    assert spark.createDataFrame([(None,)], "t string").select(columns(F.col("t"))).first()[0] is None
