"""Sessions as markdown, written out."""

from leafline.operators import session, tree
from leafline.sources import readers

REGION = "doc_id string, region_no int, type string, text string, page int, x0 double, y0 double, x1 double, y1 double, level int"
ASSET = "doc_id string, region_no int, asset_id string, type string, number int, caption string, image string, description string, table_markdown string, is_icon boolean"


def region(n, kind, text, page, level=None):
    return ("d", n, kind, text, page, float(n), 1.0, n + 0.5, 2.0, level)


ROWS = [
    region(0, "text", "Before", 0),
    region(1, "paragraph_title", "One", 0, 1),
    region(2, "text", "first\n# One", 0),  # a line of text that reads as a heading takes part in the numbering of ids
    region(3, "figure", None, 0),
    region(4, "figure_title", "Fig. #1  shows", 0),
    region(5, "text", "second", 1),
    region(6, "paragraph_title", "One", 1, 2),
    region(7, "table", None, 1),
    region(8, "figure", None, 1),
    region(9, "figure", None, 2),
    region(10, "paragraph_title", "", 2, 2),
    region(11, "figure_title", "Far caption", 1),
]
ASSETS = [
    ("d", 3, "fig_1", "figure", 1, "Fig. #1  shows", "x/one.png", "a thing", None, False),
    ("d", 7, "tab_1", "table", 1, "Rates", "t.png", None, "| a |\n| --- |", False),
    ("d", 8, "fig_2", "figure", 2, "Second", "two.png", "", "", False),
    ("d", 9, "fig_3", "figure", 3, "", "i.png", None, None, True),
]
EXPECTED = """Before

# One

```pin
id: one
kind: section
doc: d
page: 1
bbox: [1.0, 1.0, 1.5, 2.0]
regions: [[1, 2.0, 1.0, 2.5, 2.0], [2, 5.0, 1.0, 5.5, 2.0]]
scale: 2.0
```

first
# One

second

## Fig. 1 shows

```pin
id: fig-1-shows
kind: asset
doc: d
asset: fig_1
type: figure
page: 1
bbox: [3.0, 1.0, 3.5, 2.0]
image: /assets/d/one.png
scale: 2.0
```

![figure 1](/assets/d/one.png)

Fig. #1  shows a thing

## One

```pin
id: one-3
kind: section
doc: d
page: 2
bbox: [6.0, 1.0, 6.5, 2.0]
regions: [[2, 11.0, 1.0, 11.5, 2.0]]
scale: 2.0
golden: Q1, Q2
```

Far caption

### Likely icons/broken infographics

```pin
id: likely-icons-broken-infographics
kind: section
doc: d
page: 3
bbox: [9.0, 1.0, 9.5, 2.0]
regions: [[3, 9.0, 1.0, 9.5, 2.0]]
scale: 2.0
```

1 small graphics of nearly one size (1 on page 3), without captions: likely icons or parts of one infographic, not described.

![figure 3](/assets/d/i.png)

### Figures and tables

```pin
id: figures-and-tables
kind: section
doc: d
page: 2
bbox: [7.0, 1.0, 7.5, 2.0]
regions: [[2, 7.0, 1.0, 8.5, 2.0]]
scale: 2.0
```

#### Rates

```pin
id: rates
kind: asset
doc: d
asset: tab_1
type: table
page: 2
bbox: [7.0, 1.0, 7.5, 2.0]
image: /assets/d/t.png
scale: 2.0
```

| a |
| --- |

Rates

#### Second

```pin
id: second
kind: asset
doc: d
asset: fig_2
type: figure
page: 2
bbox: [8.0, 1.0, 8.5, 2.0]
image: /assets/d/two.png
scale: 2.0
```

![figure 2](/assets/d/two.png)

Second
"""


def test_session_markdown(spark):
    golden = spark.createDataFrame([("d", "one-3", "Q2"), ("d", "one-3", "Q1"), ("d", "no such", "Q9")], "doc_id string, node_id string, label string")
    regions, assets = spark.createDataFrame(ROWS, REGION).repartition(3), spark.createDataFrame(ASSETS, ASSET)
    made = session.session_markdown(regions, assets, golden=golden)
    assert made.first().markdown == EXPECTED
    docs = spark.createDataFrame([("d", EXPECTED)], "doc_id string, text string")
    assert sorted(tuple(r) for r in readers.label_pins(docs).collect()) == [("d", "Q1", "one-3"), ("d", "Q2", "one-3")]
    pinned = {r.node_id: r.pin["id"] for r in tree.nodes(docs).where("pin IS NOT NULL AND NOT synthetic").collect()}
    assert all(k == v for k, v in pinned.items()) and len(pinned) == 7  # every pin names the node that it stands under
    assert session.session_markdown(regions.limit(0), assets.limit(0)).collect() == []
