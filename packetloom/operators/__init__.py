"""DataFrame -> DataFrame operators; chain them with ``df.transform``.

Rows carry ``epoch_id``; every grouping includes it, so state starts empty in each epoch.
"""
