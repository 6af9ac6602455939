"""codesieve: bulk source-review analytics on Spark.

Select files of many repositories, classify and review them with ordered
text rules, and keep the results in repository / review / feedback tables,
all as DataFrame and SQL operations planned by Catalyst.

Main entry points:

* :func:`codesieve.operators.feedback.review_files` - per-file review (flagship)
* :func:`codesieve.operators.select.select_files` - per-repository selection by mode
* :func:`codesieve.sources.snapshots.changed_files` - snapshot diff per run
* :func:`codesieve.plans.corpus.run_review` - one whole review run against a table store
* :func:`codesieve.streaming.requests.start_review_stream` - review requests as a stream
"""

__version__ = "0.1.0"
