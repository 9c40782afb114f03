-- Rows to score for one day: the id column and the feature columns.
-- The day is a half-open window on the date column, so a timestamp column
-- keeps its last day and the predicate still reaches the Parquet scan.
SELECT {id_column}, {features}
FROM IDENTIFIER(:table_name)
WHERE IDENTIFIER(:date_column) >= CAST(:day_start AS {date_type})
  AND IDENTIFIER(:date_column) < CAST(:day_end AS {date_type})
