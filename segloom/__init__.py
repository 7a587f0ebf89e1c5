"""segloom: Spark-native analytics over timed, labelled segments and the conversation records around them."""
