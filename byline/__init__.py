"""byline: scholarly attribution as Spark DataFrame operators.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing in the package calls an action unless its docstring says so.
"""
