-- Training rows for a model: the feature columns, the label renamed to
-- `target`, rows inside an inclusive date window, labelled rows only (a
-- floating label that is NaN is none), and a repeatable keyed sample (first
-- 32 bits of md5 of the key, below fraction * 2^32).  Values arrive as named parameters; identifiers arrive
-- through IDENTIFIER(:name) or, for the feature and key lists, as names that
-- were checked against the table schema and back-quoted.
SELECT {features},
       IDENTIFIER(:target_column) AS target
FROM IDENTIFIER(:table_name)
WHERE IDENTIFIER(:date_column) >= CAST(:window_start AS {date_type})
  AND IDENTIFIER(:date_column) < CAST(:window_end AS {date_type})
  AND {label_present}
  AND CAST(conv(substr(md5({sample_key}), 1, 8), 16, 10) AS BIGINT)
      < CAST(:sample_fraction AS DOUBLE) * 4294967296D
