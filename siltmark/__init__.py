"""siltmark: Spark-native analytics over versioned logs, mergeable state, content trees and document corpora."""
