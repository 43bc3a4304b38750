DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **columns):
    """Documents of the given texts with ids from 0, in two partitions."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(2)


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def real(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
