from claimloom.sources.markdown import segment_candidates, segments

TEXT = """---
title: x
---
# Top

First paragraph
goes on.

## Sub

- item one
  continued
- item two

  second paragraph

```
code is
```

> quoted

| a | b |
|---|---|
| 1 | 2 |

Setext
======

Last é paragraph.   
"""


def test_segments():
    got = segments(TEXT)
    raw = TEXT.encode()
    assert [(s["text"].split("\n")[0], s["heading_path"]) for s in got] == [
        ("First paragraph", ["Top"]),
        ("- item one", ["Top", "Sub"]),
        ("- item two", ["Top", "Sub"]),
        ("second paragraph", ["Top", "Sub"]),
        ("Last é paragraph.", ["Setext"]),
    ]
    for s in got:
        assert raw[s["char_start"] : s["char_end"]].decode() == s["text"]
        assert raw[: s["char_start"]].count(b"\n") + 1 == s["line_start"]


def test_segment_table(spark):
    rows = segment_candidates(spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "d int, text string"))
    assert rows.where("d = 1").count() == 5 and rows.where("d > 1").count() == 0
