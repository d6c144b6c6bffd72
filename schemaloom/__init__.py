"""schemaloom: dependency-aware schema matching and corpus preparation on PySpark.

``operators``  profiles, column signals, dependency checks, graph, refinement, metrics
``sources``    readers and writers of tables, dependency files, matrices
``functions``  column expressions shared by the operators
``plans``      pipelines and the query catalogue with its SQL counterparts
``streaming``  incremental profiles
``llm``        training-data operators; nothing above imports it
"""
