import hashlib
import random

from pyspark.sql import functions as F

from textloom.operators import order
from textloom.sources import files


def brute(texts):
    total = [0, 0]
    for i, t in enumerate(texts):
        digits = hashlib.md5(t.encode()).hexdigest()
        for k, base in enumerate(order.BASES):
            total[k] += int(digits[8 * k : 8 * k + 8], 16) * pow(base, i, order.PRIME)
    return total[0] % order.PRIME * 2**31 + total[1] % order.PRIME


def test_digest_tells_the_order(spark):
    texts = [f"line {i % 7}" for i in range(300)]
    swapped = texts[:10] + [texts[12], texts[11], texts[10]] + texts[13:]
    for part in (texts, swapped, texts[:1], texts + [""]):
        rows = spark.createDataFrame(list(enumerate(part)), "place long, line string").orderBy(F.rand(1)).repartition(5)
        assert tuple(order.order_digest(rows, "place", "line").first()) == (len(part), brute(part))
    assert brute(texts) != brute(swapped)
    assert tuple(order.order_digest(rows.limit(0), "place", "line").first()) == (0, 0)


def test_places_of_many_bits(spark):
    place = 5 * 2**38 + 12345
    power = order._power(order._power_tables(order.BASES[0]), F.lit(place))
    assert spark.range(1).select(power).first()[0] == pow(order.BASES[0], place, order.PRIME)


def test_lines_of_split_files_have_global_numbers(spark, tmp_path):
    rnd = random.Random(1)
    want, place = [], 0
    for name in ("a/1.txt", "a/2.txt", "b.txt"):
        lines = ["".join(rnd.choices("ab é", k=rnd.randint(0, 40))) for _ in range(400)]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "b.txt" else ""))
        want += [(name, i, place + i, line) for i, line in enumerate(lines)]
        place += len(lines)
    (tmp_path / "c.md").write_text("no line")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        assert spark.read.text(f"{tmp_path}/a").rdd.getNumPartitions() > 4
        got = files.scan_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.path.split(str(tmp_path) + "/")[1], r.line_no, r.place, r.line) for r in got) == want
