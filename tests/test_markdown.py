"""Markdown blocks against a plain state machine over lines."""

import random

from pyspark.sql import functions as F

from lodestone.operators import parse

SCHEMA = "doc_id int, text string"


def plain(text):
    path, blocks, held, fenced = [], [], [], False

    def close(kind):
        body = "\n".join(held).strip()
        held.clear()
        if body:
            blocks.append((kind, body, list(path)))

    for line in (text or "").splitlines():
        bare = line.strip()
        if line.startswith("```"):
            close("code" if fenced else "paragraph")
            fenced = not fenced
        elif fenced:
            held.append(line)
        elif bare.startswith("#"):
            close("paragraph")
            name = bare.lstrip("#")
            level = len(bare) - len(name)
            if name.strip():
                del path[level - 1 :]
                blocks.append(("heading", name.strip(), list(path)))
                path.append(name.strip())
        elif bare:
            held.append(line)
        else:
            close("paragraph")
    close("code" if fenced else "paragraph")
    return blocks


def found(spark, texts):
    rows = {}
    out = parse.markdown_blocks(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        rows.setdefault(r["doc_id"], []).append((r["pos"], r["block_type"], r["text"], r["section_path"]))
    return [[b[1:] for b in sorted(rows.get(i, []))] for i in range(len(texts))], rows


def test_line_ends_fences_and_blank_lines(spark):
    texts = ["```\r\n  code  \r\n```", "a\rb\r\rc", "```\n\n\n  x\n\ny  \n\n```\nafter", "``` \n```", "# T\n```\nnever closed", "\x0ba\x0cb\x1cc\x85d\u2028e", None, "", "\n\n", "   # T  \n#\n ## \n####  deep ## \n### x", " ```\nno fence", "### A\n## B\nb\n# C\nc\n### D\n## E\ne"]
    got, rows = found(spark, texts)
    assert got == [plain(t) for t in texts]
    assert got[0] == [("code", "code", [])] and all(sorted(p for p, *_ in r) == list(range(len(r))) for r in rows.values())


def test_random_texts(spark):
    rng = random.Random(6)
    pieces = ["# ", "## ", "#### ", "```", "```py", "word ", " ", "\n", "\n\n", "\r\n", "\r", "#", "x\ty", "é", "\n# H", "\n### K\n", "\n```\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    got, _ = found(spark, texts)
    assert got == [plain(t) for t in texts]


def test_a_long_text(spark):
    text = "".join(f"# h{i}\nline {i}\n\n## k{i}\nmore\n```\ncode {i}\n```\n" for i in range(3000))
    out = parse.markdown_blocks(spark.createDataFrame([(0, text)], SCHEMA))
    assert out.groupBy("block_type").count().orderBy("block_type").collect() == [("code", 3000), ("heading", 6000), ("paragraph", 6000)]
    last = out.orderBy(F.desc("pos")).first()
    assert (last["text"], last["section_path"]) == ("code 2999", ["h2999", "k2999"])
