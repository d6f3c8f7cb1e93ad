"""Suffix arrays in the JVM by linear grouping, and what of each string repeats an earlier document.

The construction works on integers: Python is too slow for it, so it is a small Java class that Spark's own Janino compiles on the
driver and that executors fetch as a jar; no toolchain is needed.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

_CLASS = "maxentnet.Grouping"

JAVA = r"""
package maxentnet;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;

public class Grouping implements org.apache.spark.sql.api.java.UDF1, java.io.Serializable {

  /* Suffix array of text, whose last symbol 0 is the only one of its kind.

     A group holds suffixes that share a prefix, known by the first place it takes in the order of groups. Groups are taken from
     the highest down. For each suffix of a group the nearest earlier suffix of a lower group is its parent: that suffix begins
     with its group's prefix and then this one's. Suffixes with more children in the group are larger than those with fewer, and
     all are larger than those of their group that have none, so they go to new groups right above it, those with most children
     last. In the end each group holds the suffixes with one Lyndon prefix, and the groups stand in order. Then the suffixes are
     put in order: from the least on, the suffix before each one placed, and its chain of parents, take the next free places of
     their groups. */
  static int[] suffixes(int[] text, int symbols) {
    int n = text.length;
    int[] order = new int[n], place = new int[n], group = new int[n], size = new int[n], parent = new int[n];
    int[] fill = new int[symbols + 1];
    for (int i = 0; i < n; i++) fill[text[i] + 1]++;
    for (int c = 0; c < symbols; c++) fill[c + 1] += fill[c];
    int[] next = new int[symbols];
    for (int c = 0; c < symbols; c++) next[c] = fill[c];
    for (int i = 0; i < n; i++) {
      int c = text[i];
      group[i] = fill[c];
      place[i] = next[c];
      order[next[c]++] = i;
    }
    for (int c = 0; c < symbols; c++) if (fill[c] < n) { if (fill[c + 1] > fill[c]) size[fill[c]] = fill[c + 1] - fill[c]; }
    for (int i = 0; i < n; i++) parent[i] = -2;
    int[] children = new int[n], touched = new int[n], stack = new int[n + 1], sorted = new int[n];
    int end = n;
    while (end > 0) {
      int begin = group[order[end - 1]];
      int many = 0, most = 0;
      for (int k = begin; k < end; k++) {
        int s = order[k];
        /* parents of this group's suffixes that stand before s in one chain are found first */
        int depth = 0;
        stack[depth++] = s;
        while (depth > 0) {
          int t = stack[depth - 1];
          if (parent[t] != -2) { depth--; continue; }
          int p = t - 1;
          boolean known = true;
          while (p >= 0 && group[p] >= begin) {
            if (parent[p] == -2) { known = false; break; }
            p = parent[p];
          }
          if (known) { parent[t] = p; depth--; } else stack[depth++] = p;
        }
        int p = parent[s];
        if (p >= 0) {
          if (children[p]++ == 0) touched[many++] = p;
          if (children[p] > most) most = children[p];
        }
      }
      if (many > 0) {
        /* counting sort of the parents by their children, most first */
        int[] at = new int[most + 2];
        for (int k = 0; k < many; k++) at[most - children[touched[k]] + 1]++;
        for (int k = 0; k <= most; k++) at[k + 1] += at[k];
        for (int k = 0; k < many; k++) sorted[at[most - children[touched[k]]]++] = touched[k];
        int from = 0;
        while (from < many) {
          int to = from;
          int same = children[sorted[from]];
          while (to < many && children[sorted[to]] == same) to++;
          for (int k = from; k < to; k++) {  /* to the end of what is left of their group */
            int p = sorted[k], g = group[p];
            int last = g + --size[g];
            int other = order[last], here = place[p];
            order[here] = other;
            place[other] = here;
            order[last] = p;
            place[p] = last;
          }
          for (int k = from; k < to; k++) {
            int p = sorted[k], g = group[p];
            int start = g + size[g];
            stack[k - from] = start;
          }
          for (int k = from; k < to; k++) {
            int p = sorted[k], start = stack[k - from];
            group[p] = start;
            size[start]++;
          }
          from = to;
        }
        for (int k = 0; k < many; k++) children[touched[k]] = 0;
      }
      end = begin;
    }
    boolean[] placed = new boolean[n];
    int[] free = children;
    for (int i = 0; i < n; i++) free[i] = 0;
    order[0] = n - 1;
    placed[n - 1] = true;
    for (int i = 0; i < n; i++) {
      int s = order[i] - 1;
      while (s >= 0 && !placed[s]) {
        int g = group[s];
        order[g + free[g]++] = s;
        placed[s] = true;
        s = parent[s];
      }
    }
    return order;
  }

  /* Length of what each suffix in the order has in common with the one before it. */
  static int[] common(int[] text, int[] order) {
    int n = text.length;
    int[] rank = new int[n], out = new int[n];
    for (int i = 0; i < n; i++) rank[order[i]] = i;
    int length = 0;
    for (int i = 0; i < n; i++) {
      if (rank[i] == 0) { length = 0; continue; }
      int j = order[rank[i] - 1];
      while (i + length < n && j + length < n && text[i + length] == text[j + length]) length++;
      out[rank[i]] = length;
      if (length > 0) length--;
    }
    return out;
  }

  public static byte[] order(byte[] data) {
    int[] text = new int[data.length + 1];
    for (int i = 0; i < data.length; i++) text[i] = (data[i] & 255) + 1;
    int[] order = suffixes(text, 258);
    ByteBuffer out = ByteBuffer.allocate(4 * data.length).order(ByteOrder.LITTLE_ENDIAN);
    for (int i = 1; i < order.length; i++) out.putInt(order[i]);
    return out.array();
  }

  /* Input: kind 0, then bytes: their suffix array. Kind 1: width and number of strings, owner of each (8 bytes), length of each
     (4 bytes), the strings' bytes; output: for each place of each string 1 if the width bytes from there on stand in a string with a
     smaller owner too. */
  public Object call(Object value) {
    if (value == null) return null;
    byte[] data = (byte[]) value;
    ByteBuffer in = ByteBuffer.wrap(data).order(ByteOrder.LITTLE_ENDIAN);
    int kind = in.getInt();
    if (kind == 0) {
      byte[] rest = new byte[data.length - 4];
      in.get(rest);
      return order(rest);
    }
    int width = in.getInt(), count = in.getInt();
    long[] owner = new long[count];
    int[] length = new int[count];
    int total = 0;
    for (int i = 0; i < count; i++) owner[i] = in.getLong();
    for (int i = 0; i < count; i++) { length[i] = in.getInt(); total = Math.addExact(total, length[i]); }
    /* symbol 1 parts the strings */
    int[] text = new int[total + count + 1], of = new int[total + count + 1], left = new int[total + count + 1];
    int at = 0;
    for (int i = 0; i < count; i++) {
      for (int k = 0; k < length[i]; k++) {
        of[at] = i;
        left[at] = length[i] - k;
        text[at++] = (in.get() & 255) + 2;
      }
      of[at] = i;
      text[at++] = 1;
    }
    int[] order = suffixes(text, 258);
    int[] common = common(text, order);
    byte[] flags = new byte[total];
    int n = text.length;
    int from = 0;
    while (from < n) {
      int to = from + 1;
      while (to < n && common[to] >= width) to++;
      if (to - from > 1 && left[order[from]] >= width) {
        long least = Long.MAX_VALUE;
        for (int k = from; k < to; k++) if (left[order[k]] >= width) least = Math.min(least, owner[of[order[k]]]);
        for (int k = from; k < to; k++) {
          int s = order[k];
          if (left[s] >= width) { if (owner[of[s]] > least) flags[s - of[s]] = 1; }
        }
      }
      from = to;
    }
    return flags;
  }
}
"""


def registered(spark: SparkSession) -> str:
    """Name of the SQL function for this session; compiles and ships the class at the first call."""
    name = "maxentnet_grouping"
    if not spark.catalog.functionExists(name):
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(JAVA)
        codes = compiler.getBytecodes()
        jar = f"{tempfile.mkdtemp(prefix='maxentnet-jar-')}/grouping-{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for entry in codes:
                out.writestr(entry.replace(".", "/") + ".class", bytes(codes[entry]))
        spark.sql(f"ADD JAR '{jar}'")  # the driver serves it to executors
        one = compiler.getClassLoader().loadClass(_CLASS).getDeclaredConstructor(spark._sc._gateway.new_array(spark._jvm.Class, 0)).newInstance(spark._sc._gateway.new_array(spark._jvm.Object, 0))
        spark._jsparkSession.udf().register(name, one, spark._jsparkSession.parseDataType(BinaryType().json()))
    return name


def request_order(data: bytes) -> bytes:
    return struct.pack("<i", 0) + data


def request_repeats(width: int, owners: np.ndarray, strings: list[bytes]) -> bytes:
    """Asks for places whose next ``width`` bytes a string with a smaller owner has too."""
    return struct.pack("<iii", 1, width, len(strings)) + owners.astype("<i8").tobytes() + np.array([len(s) for s in strings], "<i4").tobytes() + b"".join(strings)


def grouped(spark: SparkSession, request: Column) -> Column:
    return F.call_function(registered(spark), request)
