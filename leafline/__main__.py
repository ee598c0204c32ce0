"""python -m leafline index KB OUT | query OUT QUESTION [BUDGET] | list: the library's plans from a shell."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from leafline.operators import tree
from leafline.plans.retrieve import retrieve, select_sections
from leafline.plans.judge import lexical_judge
from leafline.session import session
from leafline.sources.readers import markdown
from leafline.sources.writers import write_partitions


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        from leafline.queries import QUERIES

        print(*QUERIES, sep="\n")
        return 0
    if args[:1] == ["index"] and len(args) == 3:
        nodes = tree.with_ancestors(tree.nodes(markdown(session(), args[1])))
        write_partitions(nodes.join(tree.heuristic_summaries(nodes), ["doc_id", "node_seq"]), args[2], "doc_id")
        return 0
    if args[:1] == ["query"] and len(args) in (3, 4):
        spark = session()
        nodes = spark.read.parquet(args[1])
        asked = spark.createDataFrame([(1, args[2])], "query_id int, query string")
        picked = select_sections(nodes, F.lit(args[2]), lexical_judge(0.2))
        found = retrieve(nodes, asked, int(args[3]) if len(args) == 4 else 8000, selected=picked)
        found.where("status = 'retrieved'").orderBy("source_no").show(100, truncate=False)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
