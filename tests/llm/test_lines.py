from docquarry.llm.lines import clean_documents, dedup_lines

SCHEMA = "doc_id long, text string, source string, n_chars long"


def brute(rows, least=10):
    sites, keeper = {}, {}
    trim = lambda x: x.strip(" \t\r\x0b\x0c")
    for i, text, source, _ in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(trim(line), set()).update([source] if source is not None else [])
            if i is not None:
                keeper[trim(line)] = min(i, keeper.get(trim(line), i))
    out = []
    for i, text, _, _ in rows:
        if text is None:
            out.append((i, 0, 0, None))
            continue
        split = text.split("\n")
        keep = [x for x in split if not trim(x) or len(sites[trim(x)]) < least or keeper.get(trim(x)) is None or keeper[trim(x)] == i]
        out.append((i, len(split), len(split) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.clean) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "source", "n_chars")
    want = brute([tuple(r) for r in docs.collect()])
    assert found(dedup_lines(docs)) == want
    assert sum(w[2] for w in want) > 0


def test_thresholds_are_exact(spark):
    rows = [(100 * s + k, f"line on {s} sites\nown {s} {k}", f"s{k}", 0) for s in range(8, 13) for k in range(s)]
    rows += [(5000 + k, "one site only\nown", "s0", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(dedup_lines(docs)) == brute(rows)


def test_odd_rows(spark):
    rows = [(k, "common\n\n  \nown " + str(k), f"s{k}", 9) for k in range(12)] + [(1, None, "a", 0), (2, "", None, 0), (None, "common", "b", 1), (3, "common", "z", 1), (3, "common", "z", 1), (20, "\tcommon \r", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as sites")
    assert found(dedup_lines(docs)) == brute(rows)
    kept = clean_documents(docs).collect()
    assert kept[0].__fields__ == docs.columns
    assert 20 not in {r.doc_id for r in kept}
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
    assert dedup_lines(docs.where("false")).count() == 0


def test_clashing_names(spark):
    rows = [(k, f"common\nown {k}", f"s{k}", 1, k, "h", k) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _id long, _hash string, n_lines long")
    out = dedup_lines(docs).collect()
    assert all((r._id, r._hash, r.n_lines) == (r.doc_id, "h", 2) for r in out) and sum(r.n_removed for r in out) == 11
    assert {(r._id, r._hash, r.n_lines) for r in clean_documents(docs).collect()} == {(k, "h", k) for k in range(12)}
