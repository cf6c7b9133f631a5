"""lexiforge: catalogue records to QA corpora and hybrid search, as Spark jobs.

Sub-packages:
  functions/  pure ``Column`` expressions (codes, text, predicates)
  operators/  DataFrame -> DataFrame operators (canonical rows, lookups,
              nesting, QA templates, corpus preparation, retrieval, fuzzy join)
  sources/    typed readers and writers (card tables, combo JSON, QA store,
              search index store)
  plans/      driver-table analogs and the registered queries
  streaming/  the same narrow operators on streaming DataFrames
"""

__version__ = "0.1.0"
