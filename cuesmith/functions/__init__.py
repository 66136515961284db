"""Column functions: timecodes, frames, words, hashes. All run inside the JVM."""
