"""The crawl at its production depth against a plain breadth-first search."""

from pyspark.sql import functions as F

from webloom.plans import store
from webloom.plans.tables import sql


def test_crawl_of_the_whole_table(spark, tmp_path):
    folder = str(tmp_path)
    url = F.concat(F.lit("https://h"), (F.col("id") % 7).cast("string"), F.lit(".example.com/p"), F.col("id").cast("string"))
    spark.range(3000).select(F.col("id").alias("page_id"), url.alias("url")).write.parquet(f"{folder}/pages.parquet")
    after = {}
    for r in sql(spark, folder, store.LINKS, "pages").collect():
        after.setdefault(r["src"], []).append(r["dst"])
    want = {}
    for first in range(7):
        depth, turn = {first: 0}, [first]
        for d in range(1, 11):
            turn = list({q for p in turn for q in after.get(p, []) if q not in depth})
            depth |= dict.fromkeys(turn, d)
        want |= {(f"https://h{first}.example.com", p): d for p, d in depth.items()}
    got = {(r["origin"], int(r["url"])): r["depth"] for r in store.c1_c2_crawl(spark, folder).collect()}
    assert got == want and max(want.values()) > 4 and len(want) > 7 * 341
