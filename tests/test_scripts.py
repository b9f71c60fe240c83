"""Functions of scripts: names, ends, comments, replacement, insertions."""

import hashlib

from pyspark.sql import functions as F

from lexloom.operators import baseline

TEXT = """module A
  # a note
  class B::C < D
    def x(y) # begins
      if y
        z = "# no note" # stays
      end

      y.each do |w|
        w #goes
        w#{stays}
      end
    end
    def self . z?
    end
    def one; 1; end
  end
  class E
    def x
      while true do
        1
      end
    end
    def [](i)
      i\r
    end
  end
end
def x
  first
end
def x
  last"""


def fp(*lines):
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12]


def test_qualified_names_and_bodies(spark):
    files = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "end\nend\nx")], "script int, text string")
    made = {(r.script, r.fn): r.fp for r in baseline.scan_functions(files).collect()}
    assert made == {
        (1, "A.B::C.x"): fp("if y", 'z = "# no note" # stays', "end", "y.each do |w|", "w", "w#{stays}", "end"),
        (1, "A.B::C.self.z?"): fp(),
        (1, "A.E.x"): fp("while true do", "1", "end"),
        (1, "A.E.[]"): fp("i"),
        (1, "x"): fp("last"),
    }
    assert baseline.scan_functions(files.limit(0)).collect() == []


def test_sources_of_functions(spark):
    text = "class A\n  def x\n    if y\n    end\n    1\n  end\n  def xy\n    2"
    rows = spark.createDataFrame([(text, "A.x"), (text, "xy"), (text, "z"), (text, None), (None, "x"), ("", "")], "text string, fn string")
    found = baseline.function_source("text", "fn")
    made = [tuple(r) for r in rows.select(found, baseline.replaced_function(F.col("text"), F.col("fn"), F.lit("  new"))).collect()]
    assert made == [
        ("  def x\n    if y\n    end\n    1\n  end", "class A\n  new\n  def xy\n    2"),
        ("  def xy\n    2", "class A\n  def x\n    if y\n    end\n    1\n  end\n  new"),
        ("", None),
        ("", None),
        ("", None),
        ("", None),
    ]


def test_insertions_go(spark):
    rows = spark.createDataFrame([("a\n $DEBUG=true \nb # [mark] x\nc $DEBUG=true\r\n[mark]\r\nd",), (None,)], "text string")
    made = [r[0] for r in rows.select(baseline.without_marked_lines(F.col("text"), "[mark]", "$DEBUG=true")).collect()]
    assert made == ["a\n\n\nc $DEBUG=true\r\n\nd", None]
