"""Property-listing analytics as Spark jobs.

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function; nothing here runs an action unless its docstring says so.
"""
