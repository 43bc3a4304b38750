"""Both reports from hand-made rows."""

from proseline.operators.texts import configuration_report, sweep_report

KIND = "id long, temperature double, min_p double, adaptive_target double, response string, quality_score double, repetition_penalty double, coherence_score double, readability_score double, response_length long"


def rows(spark):
    return spark.createDataFrame([
        (2, 1.2, 0.1, 0.5, "second", 0.8, 0.1, 0.8, 0.6, 6), (1, 1.2, 0.1, 0.5, "first " * 60, 0.6, 0.1, 0.8, 0.6, 360),
        (3, 0.9, 0.05, 0.0, None, 0.5, 0.6, 0.4, 0.5, 0), (4, None, 0.1, 0.5, "no key", 1.0, 0.0, 1.0, 1.0, 6),
    ], KIND)


def test_configurations(spark):
    text = configuration_report(rows(spark))
    parts = text.split("## Rank ")
    assert len(parts) == 3 and "no key" not in text
    assert "temperature: `1.20`" in parts[1] and "min_p: `0.100`" in parts[1] and "combined score: **0.770**" in parts[1] and "responses: 2" in parts[1] and "length: 183.0" in parts[1]
    assert ("first " * 60)[:200] + "..." in parts[1] and "second" not in parts[1]  # the first response, cut
    assert "warm" in parts[1] and "little repetition" in parts[1] and "hang together" in parts[1]
    assert "cool" in parts[2] and "much repetition" in parts[2] and "fall apart" in parts[2] and "```\n\n- cool" not in parts[2]
    assert '{"temperature": 1.20, "min_p": 0.100, "adaptive_target": 0.50, "adaptive_decay": 0.9}' in text
    assert configuration_report(rows(spark), k=1).count("## Rank") == 1
    assert "No configuration has a response." in configuration_report(rows(spark).limit(0))


def test_sweep(spark):
    frame = spark.sql("""SELECT * FROM VALUES (1L, 0.5D, 0.25D, 2, 0.01D, 0.4D, 3L, 'one', 1.25D, array(named_struct('pattern', 'a b', 'n', 2L), named_struct('pattern', 'c', 'n', 1L))),
      (2L, 0.9D, 0.5D, 1, 0.0D, 0.9D, 0L, 'two', 0.75D, array()), (3L, 0.5D, 0.1D, 1, 0.0D, 0.5D, 0L, CAST(NULL AS STRING), 1.0D, NULL)
      AS t(trial, overall_score, lazy_score, num_prompts_evaluated, score_variance, score_min, lazy_pattern_count, response_text, temperature, lazy_patterns_found)""")
    answers = spark.createDataFrame([(1, "p1", " text of p1 ", 0.3), (1, "p2", "x" * 3000, 0.7), (9, "p1", "other", 0.1)], "trial long, prompt string, text string, quality_score double")
    text = sweep_report(frame, ["temperature"], responses=answers, model="m", prompts=2, mode="sample", n=3)
    assert "- trials: 3" in text and "0.500 to 0.900, mean 0.633" in text and "mode sample (3 a trial)" in text
    order = [text.index(f"Trial {k},") for k in (2, 1, 3)]
    assert order == sorted(order)  # best first, ties by trial
    assert "| 2 | #1 | 0.500 | 1.25 | 0.25 | N/A | N/A | 0.010 | 0.400 |" in text
    assert text.index("| p2 | 0.700") < text.index("| p1 | 0.300") and "```\ntext of p1\n```" in text and "x" * 2000 + "\n" in text and "x" * 2001 not in text and "other" not in text
    assert "a b (2x), c (1x)" in text and "```\ntwo\n```" in text and "(no text)" in text
    assert sweep_report(frame, ["temperature"], n=1).count("## ") == 1
    assert "No completed trials" in sweep_report(frame.limit(0), ["temperature"])
