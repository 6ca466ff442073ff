"""rankweave: catalogue retrieval, ranking and evaluation as Spark jobs.

Every public operator is a function from DataFrame(s) to a DataFrame.
Sub-packages:

* ``sources``   -- readers/writers and adaptor views over the input tables
* ``functions`` -- column-expression builders (URLs, text, durations, lexicons, vectors)
* ``operators`` -- DataFrame operators (k-NN, retrieval, re-ranking, fusion, learning, evaluation)
* ``plans``     -- composed end-to-end jobs (recommend, catalogue build, evaluation reports)
* ``streaming`` -- Structured Streaming forms of recommend and page ingestion
"""

__version__ = "0.1.0"
